"""A shard's messages of a trigger are held as columns, in the order of their time."""

import random
import tracemalloc

import numpy as np
import pandas as pd

from bazaarlens.streaming import albums


def part(r, n):
    kinds = [r.choice(["image", "text", albums.FLUSH]) for _ in range(n)]
    return pd.DataFrame({"chat": 1, "sender": [r.randrange(5) for _ in range(n)], "key": [r.randrange(99) for _ in range(n)],
                         "ms": [r.randrange(50) for _ in range(n)], "kind": kinds, "bytes": 7,
                         "missing": [r.choice([True, False, None]) for _ in range(n)]})


def test_order_and_flags_of_plain_sorting():
    r = random.Random(1)
    parts = [part(r, n) for n in (40, 0, 1, 80)]
    want = sorted((m for p in parts for m in p.itertuples(index=False)), key=lambda m: (m.kind == albums.FLUSH, m.ms, m.key))
    got = list(albums.Arrivals(iter(parts)))
    assert [(m.chat, m.sender, m.key, m.ms, m.bytes, m.flush, m.photo, m.usable) for m in got] == [
        (m.chat, m.sender, m.key, m.ms, m.bytes, m.kind == albums.FLUSH, m.kind == "image", m.kind == "image" and not m.missing)
        for m in want]
    assert not list(albums.Arrivals(iter([])))


def test_a_message_takes_few_bytes():
    def parts():
        for i in range(40):
            n = np.arange(i * 5000, (i + 1) * 5000)
            yield pd.DataFrame({"chat": n % 3, "sender": n % 7, "key": n, "ms": n, "kind": "image", "bytes": n, "missing": False})

    tracemalloc.start()
    try:
        held = albums.Arrivals(parts())
        assert tracemalloc.get_traced_memory()[0] < 80 * len(held.order) and len(held.order) == 200_000
    finally:
        tracemalloc.stop()
