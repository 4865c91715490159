"""Orchard clustering against the plain method with Python integers, on ties, copies, nulls and very large numbers."""

import hashlib
import math
import random

import numpy as np
import pytest

from bazaarlens.llm import orchard

SCHEMA = "vec_id long, embedding array<double>, cluster string, v int"


def plain(rows, k, rounds, dims):
    kept = [(i, [int(math.floor(1024 * x)) if abs(x) < 2 ** 53 else 1024 * int(x) for x in e], e) for i, e, *_ in rows
            if e is not None and len(e) == dims and all(x is not None and math.isfinite(x) for x in e)]
    name = lambda i: (i is None, hashlib.sha256(f"3:{i}".encode()).hexdigest() if i is not None else "")
    cs = [x for _, x, _ in sorted(kept, key=lambda r: (name(r[0]), r[2]))[:k]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(cs))
    for _ in range(rounds):
        at = [near(x)[1] for _, x, _ in kept]
        for j in range(len(cs)):
            own = [x for (_, x, _), c in zip(kept, at) if c == j]
            if own:
                cs[j] = [sum(col) // len(own) for col in zip(*own)]
    fits = lambda x: x if x < 2 ** 63 else None
    out = [(i, *near(x)) for i, x, _ in kept]
    total = sum(d for _, d, _ in out)
    huge = any(d >= 2 ** 63 for _, d, _ in out)
    for i, d, c in out:
        own = [e for _, e, j in out if j == c]
        lost = any(e >= 2 ** 63 for e in own)
        digest = hashlib.sha256(",".join(map(str, cs[c])).encode()).hexdigest()
        yield i, c, fits(d), None if lost else fits(sum(own)), None if huge else fits(total), digest


def case(seed, n, dims, size):
    r = random.Random(seed)
    rows = [(i if r.random() < 0.9 else None, [float(r.choice([-1, 0, 0.5, r.uniform(-1, 1)]) * size) for _ in range(dims)], "x", 1)
            for i in range(n)]
    rows += [rows[0], rows[1], (rows[0][0], rows[-1][1], None, None)] * 3
    bad = [(900, None), (901, [1.0] * (dims + 1)), (902, [None] + [1.0] * (dims - 1)), (903, []),
           (904, [float("nan")] * dims), (905, [float("inf")] * dims)]
    return rows + [(i, e, "x", 1) for i, e in bad]


@pytest.mark.parametrize("seed, n, dims, size, k", [(1, 60, 3, 1, 8), (2, 40, 2, 0.004, 5), (3, 25, 3, 1e14, 4),
                                                   (4, 20, 2, 1e300, 3), (5, 2, 2, 1, 8)])
def test_against_plain(spark, seed, n, dims, size, k):
    rows = case(seed, n, dims, size)
    got = orchard.clusters(spark.createDataFrame(rows, SCHEMA), k=k, rounds=4, dims=dims)
    key = lambda t: tuple((x is None, x) for x in t)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(plain(rows, k, 4, dims), key=key)


def test_empty(spark):
    got = orchard.clusters(spark.createDataFrame([], SCHEMA))
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert got.count() == 0


def test_search_skips_distances():
    """The list of the closest centroid ends the search early, with the answer that all distances give."""
    r = np.random.default_rng(5)
    cs = r.integers(-10 ** 4, 10 ** 4, (64, 4))
    x = cs[r.integers(0, 64, 500)] + r.integers(-50, 50, (500, 4))
    at, d = orchard.Orchard(cs).nearest(x)
    gaps = ((x[:, None, :] - cs[None]) ** 2).sum(axis=2)
    assert (gaps.argmin(axis=1) == at).all() and (gaps.min(axis=1) == d).all()
