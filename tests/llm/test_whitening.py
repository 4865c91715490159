"""Whitening against numpy's eigenvectors and Python integers."""

import math
from fractions import Fraction

import numpy as np
import pytest

from bazaarlens.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, n string, component string"


def check(spark, rows, dims, wanted=8):
    kept = [(i, [math.floor(Fraction(x) * 1024) + 100000 for x in e]) for i, e, *_ in rows
            if e is not None and len(e) == dims and all(x is not None and math.isfinite(x) for x in e)]
    n = len(kept)
    s = [sum(x[j] for _, x in kept) for j in range(dims)]
    v = np.array([[sum(x[i] * x[j] for _, x in kept) * n - s[i] * s[j] for j in range(dims)] for i in range(dims)],
                 object) / (n * n)
    values, axes = np.linalg.eigh(v.astype(float))
    values, axes = values[::-1], axes[:, ::-1]
    k = int(min(wanted, (values > values[0] * 1e-12).sum()))
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA), wanted).collect()
    assert len(got) == n * k
    want = {}
    for i, x in kept:
        centred = np.array([float(Fraction(n * a - b, n)) for a, b in zip(x, s)])
        d = sum((n * a - b) ** 2 for a, b in zip(x, s))
        want.setdefault(i, []).append((d if d < 2 ** 63 else None, np.abs(centred @ axes[:, :k] / np.sqrt(values[:k]))))
    for r in got:
        c = r["component"] - 1
        assert r["n"] == n and r["identity_error"] < 1e-9
        assert math.isclose(r["explained"], values[c] / values.sum(), rel_tol=1e-9)
        assert any(d == r["deviation"] and math.isclose(y[c], abs(r["whitened"]), rel_tol=1e-7, abs_tol=1e-7)
                   for d, y in want[r["vec_id"]])
    return k


def vectors(seed, n, dims, size=1.0, rank=None):
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, rank or dims)) @ (r.standard_normal((rank or dims, dims)) * 2.0 ** -np.arange(rank or dims)[:, None])
    rows = [(i if i % 9 else None, (size * e).tolist(), "x", "y") for i, e in enumerate(x)]
    return rows + rows[:3]


BAD = [(70, None, "", ""), (71, [], "", ""), (72, [1.0], "", ""), (73, [None, 1.0, 2.0], "", ""), (74, [float("nan")] * 3, "", ""),
       (75, [float("-inf")] * 3, "", ""), (None, None, None, None)]


@pytest.mark.parametrize("seed, n, dims, size", [(1, 200, 12, 1.0), (2, 40, 3, 1.0), (3, 60, 10, 2.0 ** 30), (4, 5, 9, 1.0)])
def test_against_numpy(spark, seed, n, dims, size):
    check(spark, vectors(seed, n, dims, size) + BAD, dims)


def test_fewer_directions_than_components(spark):
    x = [(i, [float(a), float(2 * a), 5.0], "", "") for i, a in enumerate(range(20))]
    assert check(spark, x, 3) == 1


def test_no_direction(spark):
    same = [(1, [1.0, 2.0], "", ""), (2, [1.0, 2.0], "", "")]
    for rows in ([], same, same[:1], BAD[:2]):
        assert whitening.whiten(spark.createDataFrame(rows, SCHEMA)).count() == 0


def test_equal_eigenvalues(spark):
    """Four equal eigenvalues, two wanted: any two unit vectors of their space whiten."""
    x = [(i, [float(s * (i == j)) for j in range(4)], "", "") for i in range(4) for s in (1, -1)]
    got = whitening.whiten(spark.createDataFrame(x, SCHEMA), 2).collect()
    assert len(got) == 16 and all(r["identity_error"] < 1e-12 and abs(r["explained"] - 0.25) < 1e-12 for r in got)


def test_inertia():
    r = np.random.default_rng(0)
    for d in (1, 2, 5, 30):
        a = r.standard_normal((d, d))
        a = a + a.T
        assert whitening.negatives(a) == (np.linalg.eigvalsh(a) < 0).sum()
    assert whitening.negatives(np.array([[0.0, 1.0], [1.0, 0.0]])) == 1
    assert whitening.negatives(np.zeros((3, 3))) == 0
