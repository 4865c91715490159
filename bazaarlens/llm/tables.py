"""Small helpers the operators share: reading tables, fresh column names, summing fixed-size arrays over a cluster."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarlens.llm.words import mix

BATCH_ROWS = 1000
BATCH_BYTES = 2 << 20
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that the frame does not have yet, whatever extra columns it carries."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def combine_parts(parts: DataFrame, dtype: str, how: str, fan: int = 64) -> DataFrame:
    """Rows (part, data) with arrays of one fixed size per part: combined by `add` or `bitwise_or` into a row per part.

    Two rounds, the first over `fan` groups of each part; a task holds one array per part it sees, however many
    rows come in."""
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ufunc, have = getattr(np, how), {}
        for b in batches:
            for part, data in zip(b.column(0).to_pylist(), b.column(1)):
                x = np.frombuffer(data.as_py(), dtype)
                if part in have:
                    ufunc(have[part], x, out=have[part])
                else:
                    have[part] = x.copy()
        for part, x in have.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([x.tobytes()], pa.binary())],
                                             ["part", "data"])

    parts = parts.select(F.col("part").cast("int").alias("part"), "data")
    salted = parts.withColumn("salt", F.pmod(F.xxhash64("data"), F.lit(fan)))
    once = salted.repartition("part", "salt").select("part", "data").mapInArrow(fold, "part int, data binary")
    return once.repartition("part").mapInArrow(fold, "part int, data binary")


def emit_parts(data: np.ndarray, n_parts: int) -> tuple[list[int], list[bytes]]:
    return list(range(n_parts)), [x.tobytes() for x in np.split(data, n_parts)]


def joined_parts(parts: DataFrame, dtype: str, size: int, n_parts: int) -> np.ndarray:
    """The whole array on the driver. Its size is fixed by the caller and does not depend on the data."""
    out = np.zeros(size, dtype)
    width = size // n_parts
    for r in parts.collect():
        out[r["part"] * width: (r["part"] + 1) * width] = np.frombuffer(bytes(r["data"]), dtype)
    return out


def bitmap(ids: DataFrame, column: str, bits: int = 23, n_parts: int = 8) -> np.ndarray:
    """A bit per slot of a 64-bit column's hash, packed: 2^bits / 8 bytes whatever the number of rows. A set bit says
    "perhaps", a clear one "no"."""
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << bits, bool)
        for b in batches:
            seen[slot(b.column(0).drop_null().to_numpy(zero_copy_only=False), bits)] = True
        if seen.any():
            parts, data = emit_parts(np.packbits(seen), n_parts)
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(data, pa.binary())], ["part", "data"])

    parts = ids.select(F.col(column).cast("long")).mapInArrow(mark, "part int, data binary")
    return joined_parts(combine_parts(parts, "uint8", "bitwise_or"), "uint8", (1 << bits) // 8, n_parts)


def slot(ids: np.ndarray, bits: int) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)


def small_batches(spark: SparkSession) -> None:
    """Whole texts go to Python in batches of few rows and bytes, so that a worker holds little beside its arrays. A
    session that asks for even less keeps its settings; the settings stay, since frames are computed later."""
    if not 0 < int(spark.conf.get(_BATCH)) <= BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    have = spark.conf.get(_BYTES)
    if not have.isdigit() or not 0 < int(have) <= BATCH_BYTES:
        spark.conf.set(_BYTES, str(BATCH_BYTES))


def ship(spark: SparkSession, value: object) -> Callable[[], object]:
    """A broadcast value as a function. Callers state the bound on its size."""
    small_batches(spark)
    held = spark.sparkContext.broadcast(value)
    return lambda: held.value
