"""Connected components of an edge table by alternating large and small stars.

Each round is joins and grouped minima over the edges, so a hub is pre-aggregated and its join side split by adaptive
execution. Rounds are written to the shared folder in turn over two paths, so only the last two exist at any time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarlens.session import fresh_path


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _stars(edges: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the smallest node around it, then every node's smaller neighbours."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    moved = large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node reachable.

    Loops, repeated and reversed edges do no harm; edges with a null end are left out."""
    spark = edges.sparkSession
    paths = [fresh_path(spark, "stars"), fresh_path(spark, "stars")]
    kind = edges.schema[a].dataType
    whole = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    lone = whole.where(F.col(a) == F.col(b)).select(F.col(a).alias("node"))
    now = whole.where(F.col(a) != F.col(b)).select(
        F.greatest(a, b).cast(kind).alias("u"), F.least(a, b).cast(kind).alias("v")).distinct()
    turn, seen = 0, None
    while True:
        now.write.mode("overwrite").parquet(paths[turn % 2])
        now = spark.read.schema(now.schema).parquet(paths[turn % 2])
        mark = _mark(now)
        if mark == seen or not mark[0]:
            break
        seen, turn, now = mark, turn + 1, _stars(now)
    hung = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node")).union(lone).distinct().join(hung.select("node"), "node", "left_anti")
    return hung.union(roots.select("node", F.col("node").alias("component")))
