"""Ordered operators that survive a hot key.

A plain window sorts one key's rows in one task, a dead end when one key holds a third of the table. So each key is cut
into chunks that are monotone in the order (a day of a time line, a block of line numbers), the window runs inside
(key, chunk), each chunk is reduced to one row, the window runs over that far smaller table, and the two are joined.

`chunk` must be a function of the first order column that never decreases with it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = "_chunk"


def by_days(ts: Column, days: int = 1) -> Column:
    return F.floor(F.unix_seconds(ts) / (86400 * days))


def by_rows(position: Column, rows: int = 65536) -> Column:
    return F.floor(position / rows)


@dataclass(frozen=True)
class Line:
    """A key, its order, and how to cut it."""
    keys: list[str]
    order: list[Column]
    chunk: Column

    def reversed(self) -> Backward:
        return Backward(self.keys, self.order, self.chunk)

    def sorting(self) -> list[Column]:
        return self.order

    def cells(self) -> list[str]:
        return [*self.keys, CHUNK]

    def cut(self, df: DataFrame) -> DataFrame:
        return df.withColumn(CHUNK, self.chunk)

    def within(self):
        return Window.partitionBy(*self.cells()).orderBy(*self.sorting())

    def over_chunks(self):
        return Window.partitionBy(*self.keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)

    def last(self, value: str) -> Column:
        return F.max_by(value, F.struct(*[o.alias(f"o{i}") for i, o in enumerate(self.order)]))


class Backward(Line):
    def sorting(self) -> list[Column]:
        return [o.desc() for o in self.order]

    def over_chunks(self):
        return Window.partitionBy(*self.keys).orderBy(F.col(CHUNK).desc()).rowsBetween(Window.unboundedPreceding, -1)

    def last(self, value: str) -> Column:
        return F.min_by(value, F.struct(*[o.alias(f"o{i}") for i, o in enumerate(self.order)]))


def joined(rows: DataFrame, side: DataFrame, keys: list[str]) -> DataFrame:
    """A left join on keys that may be null."""
    side = side.select(*[F.col(k).alias(f"_c_{k}") for k in keys], *[c for c in side.columns if c not in keys])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_c_{k}"))
    return rows.join(side, on, "left").drop(*[f"_c_{k}" for k in keys])


def _with_carry(df: DataFrame, carry: DataFrame, line: Line) -> DataFrame:
    """Attach each chunk's carried value."""
    return joined(df, carry, line.cells())


def running_sum(df: DataFrame, line: Line, value: Column, out: str) -> DataFrame:
    """Inclusive running sum of `value` per key."""
    frame = line.within().rowsBetween(Window.unboundedPreceding, 0)
    marked = line.cut(df).withColumn("_v", value)
    totals = marked.groupBy(*line.cells()).agg(F.sum("_v").alias("_t"))
    carry = totals.select(*line.cells(), F.coalesce(F.sum("_t").over(line.over_chunks()), F.lit(0)).alias("_carry"))
    local = marked.withColumn("_s", F.coalesce(F.sum("_v").over(frame), F.lit(0)))
    return _with_carry(local, carry, line).withColumn(out, F.col("_s") + F.col("_carry")).drop(
        CHUNK, "_v", "_s", "_carry")


def row_number(df: DataFrame, line: Line, out: str) -> DataFrame:
    """1-based position per key; the order must be total for a stable answer."""
    place = F.row_number().over(line.within()).cast("long")
    marked = line.cut(df)
    totals = marked.groupBy(*line.cells()).agg(F.count(F.lit(1)).alias("_t"))
    carry = totals.select(*line.cells(), F.coalesce(F.sum("_t").over(line.over_chunks()), F.lit(0)).alias("_carry"))
    return _with_carry(marked.withColumn("_s", place), carry, line).withColumn(
        out, F.col("_s") + F.col("_carry")).drop(CHUNK, "_s", "_carry")


def prefix_max(df: DataFrame, line: Line, value: Column, out: str) -> DataFrame:
    """The largest `value` among the rows before this one; null on a key's first row."""
    frame = line.within().rowsBetween(Window.unboundedPreceding, -1)
    marked = line.cut(df).withColumn("_v", value)
    tops = marked.groupBy(*line.cells()).agg(F.max("_v").alias("_t"))
    carry = tops.select(*line.cells(), F.max("_t").over(line.over_chunks()).alias("_carry"))
    local = marked.withColumn("_s", F.max("_v").over(frame))
    return _with_carry(local, carry, line).withColumn(out, F.greatest("_s", "_carry")).drop(
        CHUNK, "_v", "_s", "_carry")


def previous(df: DataFrame, line: Line, value: Column, out: str, skip_nulls: bool = False) -> DataFrame:
    """The value of the row before (`lag`), or with `skip_nulls` the last non-null value before. On a reversed line
    that is the row after."""
    frame = line.within().rowsBetween(Window.unboundedPreceding, -1)
    boxed = F.struct(value.alias("v"))  # a box keeps a null value apart from a missing row
    if skip_nulls:
        boxed = F.when(value.isNotNull(), boxed)
    marked = line.cut(df).withColumn("_v", boxed)
    lasts = marked.groupBy(*line.cells()).agg(line.last("_v").alias("_t"))
    if skip_nulls:
        filled = marked.where(F.col("_v").isNotNull()).groupBy(*line.cells()).agg(line.last("_v").alias("_t"))
        lasts = _with_carry(marked.select(*line.cells()).distinct(), filled, line)
    carry = lasts.select(*line.cells(), F.last("_t", ignorenulls=True).over(line.over_chunks()).alias("_carry"))
    local = marked.withColumn("_s", F.last("_v", ignorenulls=True).over(frame))
    return _with_carry(local, carry, line).withColumn(out, F.coalesce("_s", "_carry")["v"]).drop(
        CHUNK, "_v", "_s", "_carry")


def placed(df: DataFrame, line: Line, value: Column, place: str, before: str) -> DataFrame:
    """`row_number` and `previous` of one line at once: the rows are dealt to their chunks and meet the carried values once."""
    frame = line.within().rowsBetween(Window.unboundedPreceding, -1)
    marked = line.cut(df).withColumn("_v", F.struct(value.alias("v")))
    chunks = marked.groupBy(*line.cells()).agg(F.count(F.lit(1)).alias("_t"), line.last("_v").alias("_l"))
    carry = chunks.select(*line.cells(), F.coalesce(F.sum("_t").over(line.over_chunks()), F.lit(0)).alias("_rows"),
                          F.last("_l").over(line.over_chunks()).alias("_carry"))
    local = marked.withColumns({"_s": F.row_number().over(line.within()).cast("long"), "_b": F.last("_v").over(frame)})
    return _with_carry(local, carry, line).withColumns({
        place: F.col("_s") + F.col("_rows"), before: F.coalesce("_b", "_carry")["v"]}).drop(
        CHUNK, "_v", "_s", "_b", "_rows", "_carry")


def trailing_count(df: DataFrame, keys: list[str], at: Column, width: int, out: str) -> DataFrame:
    """How many rows of the key lie in (at - width, at], for an integer time column. Every row is also shown to the
    next cell of the time line, so one task sees two widths of one key and no more."""
    marked = df.withColumn("_at", at).withColumn("_home", F.floor(F.col("_at") / width))
    shown = marked.withColumn(CHUNK, F.explode(F.array(F.col("_home"), F.col("_home") + 1)))
    frame = Window.partitionBy(*keys, CHUNK).orderBy("_at").rangeBetween(1 - width, 0)
    return (shown.withColumn(out, F.count(F.lit(1)).over(frame)).where(F.col(CHUNK) == F.col("_home"))
            .drop("_at", "_home", CHUNK))
