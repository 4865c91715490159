"""Vectors as exact integers, and sums of any size added up over a cluster."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE = 1024
_FAN = 32


def finite_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id and the vector as doubles, where it is not null and none of its components is null, NaN or infinite."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("v")).where(finite)


def whole_vectors(vectors: DataFrame, dims: int) -> DataFrame:
    """Of these, those with exactly `dims` components."""
    return finite_vectors(vectors).where(F.size("v") == dims)


def integers(data: np.ndarray, wide: bool, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) exactly: as 64-bit numbers, or as Python's for components that do not fit."""
    if not wide:
        return np.floor(data * scale).astype(np.int64)
    flat = [int(x) * scale if abs(x) >= 2 ** 53 else int(np.floor(x * scale)) for x in data.ravel().tolist()]
    return np.array(flat, object).reshape(data.shape)


def matrix(vectors: pa.Array, dims: int) -> np.ndarray:
    """A list column without nulls as rows of doubles."""
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), dims)


def added(rows: DataFrame) -> DataFrame:
    """Rows (cluster, n, sums) added up per cluster; sums are decimal numbers joined by commas, so they never overflow."""
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = {}
        for b in batches:
            for c, n, s in zip(*(b.column(i).to_pylist() for i in range(3))):
                m, t = have.get(c, (0, 0))
                have[c] = (m + n, t + np.array([int(x) for x in s.split(",")], object))
        yield sums_batch(have)

    schema = "cluster int, n long, sums string"
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("sums"), F.lit(_FAN)))
    once = salted.repartition("cluster", "salt").drop("salt").mapInArrow(fold, schema)
    return once.repartition("cluster").mapInArrow(fold, schema)


def sums_batch(have: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(have), pa.int32()), pa.array([n for n, _ in have.values()], pa.int64()),
         pa.array([",".join(map(str, s)) for _, s in have.values()], pa.string())], ["cluster", "n", "sums"])
