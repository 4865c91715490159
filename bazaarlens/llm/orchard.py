"""Centroid clustering with Orchard's search.

Every centroid has a list of the others by rising distance. The search for a vector walks the list of the closest
centroid so far, jumps to the list of a closer one as soon as it finds it, computes no distance twice, and stops when
the next entry is strictly further than twice the current distance: by the triangle inequality neither it nor any
later one can be nearer, nor as near. Components are integers, so distances, ties and means are exact.

A round is one pass of the vectors through tasks that hold the centroids only; what leaves a task is one row of sums
per centroid, added in a salted tree, so neither a hot cluster nor a group of copies gathers anywhere."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarlens.llm.vectors import SCALE, added, integers, matrix, sums_batch, whole_vectors
from bazaarlens.session import cut_lineage

DIMS = 64
CENTROIDS = 8
ROUNDS = 10
_NARROW = 2.0 ** 25  # components up to this size: four times a squared distance of 64 of them fits 64 bits
_LONG = 2 ** 63


class Orchard:
    """Nearest centroid of many vectors at once; all numbers are integers."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        k = len(centroids)
        gaps = [((centroids - c) ** 2).sum(axis=1) for c in centroids]
        self.lists = np.array([sorted((j for j in range(k) if j != i), key=lambda j: (gaps[i][j], j)) for i in range(k)],
                              np.int64).reshape(k, k - 1)
        self.gaps = np.array([[gaps[i][j] for j in self.lists[i]] for i in range(k)], centroids.dtype).reshape(k, k - 1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid (of equals the smallest) and squared distance of every row."""
        n, k = len(x), len(self.centroids)
        at, step = np.zeros(n, np.int64), np.zeros(n, np.int64)
        best = ((x - self.centroids[0]) ** 2).sum(axis=1)
        visited = np.zeros((n, k), bool)
        visited[:, 0] = True
        open_ = np.arange(n if k > 1 else 0)
        while len(open_):
            open_ = open_[step[open_] < k - 1]
            open_ = open_[(self.gaps[at[open_], step[open_]] <= 4 * best[open_]).astype(bool)]
            other = self.lists[at[open_], step[open_]]
            step[open_] += 1
            new = ~visited[open_, other]
            rows, other = open_[new], other[new]
            visited[rows, other] = True
            d = ((x[rows] - self.centroids[other]) ** 2).sum(axis=1)
            closer = ((d < best[rows]) | ((d == best[rows]) & (other < at[rows]))).astype(bool)
            rows, other = rows[closer], other[closer]
            at[rows], best[rows], step[rows] = other, d[closer], 0
        return at, best


def _assigned(kept: DataFrame, centroids: np.ndarray, wide: bool) -> DataFrame:
    dims = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Orchard(centroids)
        for b in batches:
            at, d = index.nearest(integers(matrix(b.column(1), dims), wide))
            d = [x if x < _LONG else None for x in d.tolist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(at, pa.int32()), pa.array(d, pa.int64())],
                                             ["vec_id", "cluster", "distance"])

    return kept.mapInArrow(run, "vec_id long, cluster int, distance long")


def _sums(kept: DataFrame, centroids: np.ndarray, wide: bool) -> DataFrame:
    dims = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, have = Orchard(centroids), {}
        for b in batches:
            x = integers(matrix(b.column(1), dims), wide)
            at, _ = index.nearest(x)
            for c in np.unique(at).tolist():
                own = x[at == c]
                n, s = have.get(c, (0, 0))
                have[c] = (n + len(own), s + own.sum(axis=0).astype(object))
        yield sums_batch(have)

    return added(kept.mapInArrow(run, "cluster int, n long, sums string"))


def seeds(kept: DataFrame, k: int, wide: bool) -> np.ndarray:
    """The vectors with the smallest sha256 of `3:<vec_id>`; of one vec_id the smaller vector first, null ids last."""
    name = F.sha2(F.concat(F.lit("3:"), F.col("vec_id").cast("string")), 256)
    first = kept.select("v", name.alias("name")).orderBy(F.col("name").asc_nulls_last(), "v").limit(k).collect()
    return integers(np.array([r["v"] for r in first], float), wide) if first else np.empty((0, 0), np.int64)


def clusters(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for every vector with exactly `dims`
    finite components (vec_id, embedding; other columns are not read).

    Other rows are left out. Rows that repeat a vec_id are vectors of their own; a vector without a vec_id is assigned
    like any other and is a seed only if too few have one. With fewer vectors than centroids there are as many centroids as
    vectors. Ties go to the smaller number. An empty table gives an empty result. Components of any finite size are
    exact; a squared distance or sum that does not fit a long is null."""
    kept = cut_lineage(whole_vectors(vectors, dims))
    most = kept.select(F.max(F.array_max(F.transform("v", F.abs))).alias("m")).first()["m"]
    wide = most is not None and most * SCALE > _NARROW
    centroids = seeds(kept, k, wide)
    if not len(centroids):
        return kept.select("vec_id", F.lit(0).alias("cluster"), *(F.lit(0).cast("long").alias(c) for c in
                           ("distance", "cluster_inertia", "inertia")), F.lit("").alias("centroid_sha256")).limit(0)
    for _ in range(rounds):
        centroids = centroids.copy()
        for r in _sums(kept, centroids, wide).collect():  # one row a centroid
            mean = [int(s) // r["n"] for s in r["sums"].split(",")]
            centroids[r["cluster"]] = np.array(mean, centroids.dtype)
    return _with_totals(cut_lineage(_assigned(kept, centroids, wide)), centroids)


def _with_totals(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    def total(name: str) -> Column:
        whole = F.sum(F.col(name).cast("decimal(38,0)"))
        return F.when(F.count(name) == F.count(F.lit(1)), whole)

    per = assigned.groupBy("cluster").agg(total("distance").alias("own")).collect()  # one row a centroid
    own = {r["cluster"]: None if r["own"] is None else int(r["own"]) for r in per}
    every = None if None in own.values() else sum(own.values())
    fits = lambda x: x if x is not None and x < _LONG else None
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    table = assigned.sparkSession.createDataFrame(
        [(c, fits(x), fits(every), digest[c]) for c, x in sorted(own.items())],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = assigned.join(F.broadcast(table), "cluster")  # as many rows as centroids
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
