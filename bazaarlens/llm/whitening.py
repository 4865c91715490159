"""Embedding whitening by principal components, found with contour integrals (the FEAST algorithm).

The covariance is summed exactly: vectors become integers, products are added per task and then in a salted tree, so
only a matrix of the vectors' dimension reaches the driver. Counts of negative pivots (inertia) of the shifted matrix
slice its spectrum into intervals that hold the wanted eigenvalues and few others. For each interval a quadrature over
a circle around it sums solves with complex shifts, one Spark row per interval and quadrature node; that projects a
random block on the interval's eigenvectors, Rayleigh-Ritz reads off the pairs, and a round is repeated from them until
the residuals are at the level of rounding. An interval that yields another number of pairs than its inertia counts
say is an error, never a silent loss."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarlens.llm.tables import ship
from bazaarlens.llm.vectors import SCALE, added, finite_vectors, integers, matrix, sums_batch
from bazaarlens.session import cut_lineage

COMPONENTS = 8
NODES = 8  # quadrature nodes on the upper half circle; the lower half is their mirror image
SLICE = 3  # eigenvalues an interval holds at most, unless they lie closer together than CLOSE
CLOSE = 1e-8
ROUNDS = 30
_NARROW = 2.0 ** 20  # components up to this size: their products stay exact in 64 bits
_LONG = 2 ** 63
_PIVOT = (1 + math.sqrt(17)) / 8


@dataclass
class Moments:
    """Number, sums and sums of products of integer vectors: exact."""

    n: int
    sums: list[int]
    products: list[list[int]]  # row i holds those with i, i + 1, ...

    def covariance(self) -> np.ndarray:
        """Divisor n, every entry rounded once."""
        d, s, n = len(self.sums), self.sums, self.n
        out = np.zeros((d, d))
        for i in range(d):
            for j in range(i, d):
                out[i, j] = out[j, i] = (n * self.products[i][j - i] - s[i] * s[j]) / (n * n)
        return out


def moments(kept: DataFrame, dims: int, wide: bool) -> Moments:
    """One pass. A task sends a row per dimension; rows of one dimension meet in a salted tree."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, np.zeros(dims, object), np.zeros((dims, dims), object)
        for b in batches:
            u = integers(matrix(b.column(1), dims), wide)
            n += len(u)
            sums = sums + u.sum(axis=0).astype(object)
            if wide:
                products = products + u.T @ u
                continue
            f, top = u.astype(float), max(int(np.abs(u).max(initial=1)), 1)
            step = 2 ** 53 // top ** 2  # sums of so many products are exact in doubles
            for at in range(0, len(f), step):
                products = products + (f[at: at + step].T @ f[at: at + step]).astype(np.int64).astype(object)
        if n:
            yield sums_batch({i: (n, [sums[i], *products[i, i:]]) for i in range(dims)})

    rows = {r["cluster"]: r for r in added(kept.mapInArrow(run, "cluster int, n long, sums string")).collect()}
    numbers = [[int(x) for x in rows[i]["sums"].split(",")] for i in range(dims)]
    return Moments(rows[0]["n"], [x[0] for x in numbers], [x[1:] for x in numbers])


def negatives(a: np.ndarray) -> int:
    """Number of negative eigenvalues of a symmetric matrix, by the pivots of a symmetric elimination (Sylvester)."""
    a, out = a.copy(), 0
    while len(a):
        diagonal = np.abs(np.diag(a))
        p = int(diagonal.argmax())
        off = np.abs(np.triu(a, 1))
        most = off.max(initial=0.0)
        if diagonal[p] == 0 and most == 0:
            break
        if diagonal[p] >= _PIVOT * most:
            own, out = [p], out + int(a[p, p] < 0)
        else:  # a pivot of two rows with a negative determinant: one eigenvalue of either sign
            own, out = list(divmod(int(off.argmax()), len(a))), out + 1
        rest = np.delete(np.arange(len(a)), own)
        side = a[np.ix_(rest, own)]
        a = a[np.ix_(rest, rest)] - side @ np.linalg.solve(a[np.ix_(own, own)], side.T)
        a = (a + a.T) / 2
    return out


def above(v: np.ndarray, at: float) -> int:
    """Number of eigenvalues beyond a shift."""
    return negatives(at * np.eye(len(v)) - v)


def intervals(v: np.ndarray, wanted: int) -> list[tuple[float, float, int]]:
    """(low, high, eigenvalues inside) of disjoint intervals that hold at least the `wanted` largest eigenvalues beyond
    rounding, and those that cannot be told from the smallest of them."""
    top = float(np.abs(v).sum(axis=1).max()) * (1 + 1e-9)
    floor = top * len(v) * np.finfo(float).eps * 4
    wanted = min(wanted, above(v, floor))
    low, high = floor, top
    held = above(v, low)
    while held > wanted and high - low > CLOSE * high:
        mid = (low + high) / 2
        n = above(v, mid)
        low, high, held = (mid, high, n) if n >= wanted else (low, mid, held)
    out, open_ = [], [(low, top, held, 0)]
    while open_:
        a, b, over_a, over_b = open_.pop()
        n = over_a - over_b
        if n and (n <= SLICE or b - a <= CLOSE * b):
            out.append((a, b, n))
        elif n:
            mid = (a + b) / 2
            over = above(v, mid)
            open_ += [(a, mid, over_a, over), (mid, b, over, over_b)]
    return out


def _projected(spark: SparkSession, v: np.ndarray, parts: list[tuple[float, float, int]],
               blocks: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """The blocks after one contour integral around their intervals; every (interval, node) is a row of its own."""
    held = ship(spark, (v, parts, blocks))  # of the size of the covariance matrix
    x, weights = np.polynomial.legendre.leggauss(NODES)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, all_parts, ys = held()
        for b in batches:
            ks, js = b.column(0).to_pylist(), b.column(1).to_pylist()
            out = []
            for k, j in zip(ks, js):
                a, c, _ = all_parts[k]
                turn = (c - a) / 2 * np.exp(-1j * math.pi / 2 * (x[j] - 1))
                z = (a + c) / 2 + turn
                q = np.linalg.solve(z * np.eye(len(own)) - own, ys[k].astype(complex))
                out.append((weights[j] / 2 * (turn * q).real).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ks, pa.int32()), pa.array(js, pa.int32()), pa.array(out, pa.binary())],
                                             ["part", "node", "data"])

    todo = spark.createDataFrame([(k, j) for k in blocks for j in range(NODES)], "part int, node int")
    solved = todo.repartition(len(blocks) * NODES).mapInArrow(solve, "part int, node int, data binary").collect()
    sums = {k: np.zeros_like(y) for k, y in blocks.items()}
    for r in sorted(solved, key=lambda r: (r["part"], r["node"])):
        sums[r["part"]] += np.frombuffer(r["data"]).reshape(sums[r["part"]].shape)
    return sums


def _ritz(v: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenpairs of the matrix restricted to the columns' span."""
    basis, _ = np.linalg.qr(q)
    values, turned = np.linalg.eigh(basis.T @ v @ basis)
    return values, basis @ turned


def principal(spark: SparkSession, v: np.ndarray, wanted: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of a covariance matrix, falling, and their unit vectors as columns. The first largest
    entry of a vector is positive. Eigenvalues that are zero to rounding are left out."""
    d = len(v)
    parts = intervals(v, wanted)
    if not parts:
        return np.empty(0), np.empty((d, 0))
    scale, found = np.abs(v).sum(axis=1).max(), {}
    r = np.random.default_rng(13)
    blocks = {k: r.standard_normal((d, min(d, 2 * n + 4))) for k, (_, _, n) in enumerate(parts)}
    for turn in range(ROUNDS):
        for k, q in _projected(spark, v, parts, blocks).items():
            a, b, n = parts[k]
            values, vectors = _ritz(v, q)
            inside = np.flatnonzero((values >= a) & (values <= b))
            error = np.linalg.norm(v @ vectors[:, inside] - vectors[:, inside] * values[inside], axis=0)
            true = inside[error <= 1e-14 * scale * math.sqrt(d)]  # a wide block brings untrue pairs too
            if len(true) == n:
                found[k] = vectors[:, true]
            blocks[k] = vectors
        blocks = {k: y for k, y in blocks.items() if k not in found}
        if not blocks:
            break
    if blocks:
        raise RuntimeError(f"{[parts[k] for k in blocks]}: pairs found and inertia counts differ")
    values, vectors = _ritz(v, np.hstack([found[k] for k in sorted(found)]))
    first = np.argsort(-values, kind="stable")[:wanted]
    values, vectors = values[first], vectors[:, first]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(first))])
    return values, vectors * signs


@dataclass
class Model:
    """What a task needs to whiten vectors; of the size of one matrix."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    wide: bool

    def centred(self, u: np.ndarray) -> np.ndarray:
        if not self.wide:
            return u - np.array([s / self.n for s in self.sums])
        return ((self.n * u - np.array(self.sums, object)) / self.n).astype(float)

    def whitened(self, u: np.ndarray) -> np.ndarray:
        return self.centred(u) @ (self.vectors / np.sqrt(self.values))

    def deviations(self, u: np.ndarray) -> list[int]:
        """Sum of (n * u - S)^2 per vector, exactly: around the rounded mean all sums but the last step fit 64 bits."""
        n = self.n
        mean = [(2 * s + n) // (2 * n) for s in self.sums]
        rest = [s - n * m for s, m in zip(self.sums, mean)]
        tail = sum(x * x for x in rest)
        if self.wide:
            w = u - np.array(mean, object)
            cross = (w @ np.array(rest, object)).tolist()
        else:
            w = u - np.array(mean, np.int64)
            high, low = (np.array([f(x) for x in rest], np.int64) for f in (lambda x: x >> 20, lambda x: x & 0xFFFFF))
            cross = [(h << 20) + l for h, l in zip((w @ high).tolist(), (w @ low).tolist())]
        squares = (w * w).sum(axis=1).tolist()
        return [n * n * a - 2 * n * c + tail for a, c in zip(squares, cross)]


def _identity_error(kept: DataFrame, dims: int, model: Model) -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity, from the vectors themselves."""
    k = len(model.values)
    held = ship(kept.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((k, k + 1))
        for b in batches:
            y = held().whitened(integers(matrix(b.column(1), dims), held().wide))
            sums[:, :k] += y.T @ y
            sums[:, k] += y.sum(axis=0)
        i, j = np.divmod(np.arange(sums.size), k + 1)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(sums.ravel())],
                                         ["i", "j", "x"])

    out = np.zeros((k, k + 1))
    for r in kept.mapInArrow(run, "i int, j int, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).collect():
        out[r["i"], r["j"]] = r["x"] / model.n
    mean = out[:, k]
    return float(np.abs(out[:, :k] - np.outer(mean, mean) - np.eye(k)).max())


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for every vector and component (vec_id,
    embedding; other columns are not read).

    Rows whose vector is null or holds a null, NaN or infinite entry are left out, and so are vectors that have not the
    most common number of entries (of two such numbers the larger counts): they miss a dimension. Repeated rows are
    vectors of their own, a null vec_id is kept. There are as many components as eigenvalues beyond rounding, at most
    `components`: none for an empty table, a single vector or copies of one, so the result is then empty. Vectors that belong to equal eigenvalues
    are any orthonormal ones, the same for all rows. A deviation that does not fit a long is null."""
    spark = vectors.sparkSession
    schema = ("vec_id long, component int, n long, deviation long, whitened double, explained double, "
              "identity_error double")
    kept = cut_lineage(finite_vectors(vectors))
    sizes = kept.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("rows"),
                                                     F.max(F.array_max(F.transform("v", F.abs))).alias("most"))
    common = sizes.where("d > 0").orderBy(F.desc("rows"), F.desc("d")).first()
    if common is None:
        return spark.createDataFrame([], schema)
    dims, wide = common["d"], common["most"] * SCALE > _NARROW
    kept = kept.where(F.size("v") == dims)
    m = moments(kept, dims, wide)
    v = m.covariance()
    values, axes = principal(spark, v, components)
    if not len(values):
        return spark.createDataFrame([], schema)
    model = Model(m.n, m.sums, values, axes, wide)
    error, explained = _identity_error(kept, dims, model), values / np.trace(v)
    held, k = ship(spark, model), len(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, rows = held(), b.num_rows
            u = integers(matrix(b.column(1), dims), wide)
            deviation = [x if x < _LONG else None for x in own.deviations(u)]
            each = np.repeat(np.arange(rows), k)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1), rows), pa.int32()),
                 pa.array(np.full(rows * k, own.n)), pa.array(deviation, pa.int64()).take(pa.array(each)),
                 pa.array(own.whitened(u).ravel()), pa.array(np.tile(explained, rows)), pa.array(np.full(rows * k, error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return kept.mapInArrow(run, schema)
