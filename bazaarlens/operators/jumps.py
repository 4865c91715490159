"""Where does a rule that restarts cut an ordered run, without walking the run.

Some rules cut a sequence depending on where they cut it before: an album ends when too much has gathered since its own
first message. For every position taken as a start the next cut is a search of its own: the first later position whose
value is too far from the start's. All searches run together over a tree of maxima (`first_beyond`), joins only, so a run
of any length is many small tasks. The cuts that really happen are those that the first position leads to; pointer
doubling marks them (`reached`)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarlens.session import cut_lineage

FAN = 64  # children of a tree node: what one row holds and one search step looks through


@dataclass(frozen=True)
class Limit:
    """A later position is too far from a start if value - base > most (or >= most). Null values and bases never are."""
    value: str
    base: str
    most: float
    or_equal: bool = False

    def passed(self, value: Column, base: Column) -> Column:
        gap = value - base
        return F.coalesce(gap >= self.most if self.or_equal else gap > self.most, F.lit(False))


def _nodes(rows: DataFrame, run: list[str], at: str, values: list[str]) -> DataFrame:
    """A row per FAN consecutive places: their values, in order."""
    place = F.struct(F.pmod(F.col(at), F.lit(FAN)).alias("_at"), *values)
    grouped = rows.groupBy(*run, F.floor(F.col(at) / FAN).alias("node")).agg(
        F.array_sort(F.collect_list(place)).alias("held"))  # FAN entries at most
    return cut_lineage(grouped.select(*run, "node", *[F.col(f"held.{v}").alias(f"_a_{v}") for v in values]))


def first_beyond(points: DataFrame, starts: DataFrame, run: list[str], limits: list[Limit]) -> DataFrame:
    """starts (run, pos, bases) with `found`: the first place after pos whose values pass any limit; null if none does.

    points: run, pos (0, 1, 2, ... in every run), values. The search climbs from the start's node until a node holds a
    later child whose largest value passes, and descends into it."""
    values, bases = [x.value for x in limits], sorted({x.base for x in limits})
    levels, top = [_nodes(points, run, "pos", values)], points.agg(F.max("pos")).first()[0] or 0
    while top >= FAN:
        top //= FAN
        tops = [F.array_max(f"_a_{v}").alias(v) for v in values]
        levels.append(_nodes(levels[-1].select(*run, F.col("node").alias("pos"), *tops), run, "pos", values))
    own = [*run, "pos", *bases]

    def first_child(after: Column) -> Column:
        passed = lambda j: _any([x.passed(F.get(f"_a_{x.value}", j), F.col(x.base)) for x in limits])
        last = F.size(f"_a_{values[0]}") - 1
        return F.when(after <= last, F.get(F.filter(F.sequence(after, last), passed), F.lit(0)))

    open_, hits = starts.select(*own, F.col("pos").alias("_at")), []
    for level in levels:
        at = open_.withColumn("node", F.floor(F.col("_at") / FAN)).join(level, [*run, "node"])
        child = first_child((F.pmod(F.col("_at"), F.lit(FAN)) + 1).cast("int"))
        met = cut_lineage(at.select(*own, "node", child.alias("child")))
        hits.append(met.where("child is not null").select(*own, (F.col("node") * FAN + F.col("child")).alias("_at")))
        open_ = met.where("child is null").select(*own, F.col("node").alias("_at"))
    found = hits.pop()
    for level in reversed(levels[:-1]):
        into = found.withColumnRenamed("_at", "node").join(level, [*run, "node"])
        down = into.select(*own, (F.col("node") * FAN + first_child(F.lit(0))).alias("_at"))
        found = hits.pop().unionByName(down)
    found = found.select(*run, "pos", F.col("_at").cast("long").alias("found"))
    return starts.join(found, [*run, "pos"], "left")


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def reached(pointers: DataFrame, run: list[str]) -> DataFrame:
    """(run, pos) of all places that pointers (run, pos, found; found > pos or null) lead to from place 0 of their run,
    itself included. The rounds grow with the logarithm of the longest chain."""
    jump = pointers.where("found is not null").select(*run, "pos", "found")
    marked = pointers.where("pos = 0").select(*run, "pos")
    while True:
        jump = cut_lineage(jump)
        if not jump.limit(1).count():
            return marked
        met = marked.join(jump, [*run, "pos"]).select(*run, F.col("found").alias("pos"))
        marked = cut_lineage(marked.unionByName(met))
        beyond = jump.select(*run, F.col("pos").alias("found"), F.col("found").alias("_next"))
        jump = jump.join(beyond, [*run, "found"]).select(*run, "pos", F.col("_next").alias("found"))
