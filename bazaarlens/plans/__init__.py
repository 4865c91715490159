"""Registered queries: one per operator, each over the whole of its tables."""

from __future__ import annotations

import importlib

from bazaarlens.plans.registry import ORACLES, QUERIES, Query

MODULES = ("screening", "identity", "captions", "sessions", "segments", "attributes", "reposts", "matching", "search",
           "reports", "tables", "chat_export", "streams")


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"bazaarlens.plans.{m}")


def queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLES)
