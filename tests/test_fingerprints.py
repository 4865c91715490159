"""Text fingerprints: votes of words counted where the text is read, equal to the plain rule."""

import hashlib
from collections import Counter

from bazaarlens.sources import tables

ROWS = [(1, "a", " b  A a"), (1, "a", "c"), (2, None, ""), (3, "x", None), (None, "x", "É b q"), (4, "y", "w " * 500), (4, "y", " ")]


def plain(texts):
    votes = [0] * 64
    for text in texts:
        for w, n in Counter(text.lower().split(" ")).items():
            digest = hashlib.md5(w.encode()).digest()
            for half in (0, 1):
                h = int.from_bytes(digest[4 * half:4 * half + 4], "big")
                for bit in range(32):
                    votes[32 * half + bit] += n * (2 * (h >> bit & 1) - 1)
    packed = [sum(1 << b for b in range(32) if votes[32 * half + b] > 0) for half in (0, 1)]
    value = packed[0] << 32 | packed[1]
    return value - (1 << 64) if value >> 63 else value


def test_fingerprints_against_the_plain_rule(spark, monkeypatch):
    monkeypatch.setattr(tables, "VOTE_BYTES", 8)
    made = tables.simhash(spark.createDataFrame(ROWS, "doc_id long, source string, text string"), ["doc_id", "source"], "text")
    texts = {}
    for i, s, text in ROWS:
        if text is not None:
            texts.setdefault((i, s), []).append(text)
    assert {(r[0], r[1]): r[2] for r in made.collect()} == {k: plain(v) for k, v in texts.items()}
    assert "Generate" not in made._jdf.queryExecution().executedPlan().toString()  # no row per word
