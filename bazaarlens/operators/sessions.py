"""Albums: one sender's photos and text grouped by idle gap, span and size caps; and sliding quotas."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bazaarlens.operators import chunked, jumps
from bazaarlens.operators.chunked import Line
from bazaarlens.operators.folds import fold_sorted, quota_step
from bazaarlens.session import cut_lineage

MICROS = 1_000_000


@dataclass(frozen=True)
class AlbumRules:
    """60 s idle gap, 180 s span, 30 photos, 60 MiB per album."""
    idle_s: float = 60
    span_s: float = 180
    max_images: int = 30
    max_bytes: int = 60 * 1024 * 1024


def first_arrivals(msgs: DataFrame, order: list[Column]) -> DataFrame:
    """One row per (chat, key): the first arrival. The group limit ahead of the shuffle keeps redelivered keys cheap."""
    place = Window.partitionBy("chat", "key").orderBy(*order)
    return msgs.withColumn("_rn", F.row_number().over(place)).where("_rn = 1").drop("_rn")


def sender_line(order: list[Column], chunk: Column) -> Line:
    return Line(["chat", "sender"], order, chunk)


def album_islands(msgs: DataFrame, line: Line, idle_s: float) -> DataFrame:
    """Adds `island`: a number per (chat, sender) that grows at every gap longer than the idle time. Such a gap closes
    an album whatever its state, so islands can be worked on independently.

    Expects chat, sender, ts_s (double). The gap is measured from the latest time seen before, in arrival order."""
    seen = chunked.prefix_max(msgs, line, F.col("ts_s"), "_latest")
    cut = F.when(F.col("_latest").isNull() | (F.col("ts_s") - F.col("_latest") > idle_s), 1).otherwise(0)
    return chunked.running_sum(seen, line, cut, "island").drop("_latest")


def number_albums(msgs: DataFrame, line: Line, rules: AlbumRules = AlbumRules()) -> DataFrame:
    """Adds `island` and `album`. An island that breaks no cap is one album, which its totals decide. In the others
    every message is tried as the start of an album: the first later message that such an album could not take is the
    next start (`jumps`), and the starts that the island's first message leads to are the real ones."""
    run = ["chat", "sender", "island"]
    islands = cut_lineage(album_islands(first_arrivals(msgs, line.order), line, rules.idle_s))
    photo = F.col("kind") == "image"
    place = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(line.order)])
    totals = islands.groupBy(*run).agg(
        (F.max("ts_s") - F.min_by("ts_s", place) > rules.span_s) | (F.count_if(photo) > rules.max_images)
        | (F.sum(F.when(photo, F.col("bytes")).otherwise(0)) > rules.max_bytes)).toDF(*run, "_over")
    tagged = chunked.joined(islands, totals, run)
    whole = tagged.where(~F.col("_over")).drop("_over").withColumn("album", F.lit(1))
    inner = Line(run, line.order, line.chunk)
    over = cut_lineage(chunked.row_number(tagged.where("_over").drop("_over"), inner, "_pos").withColumn("_pos", F.col("_pos") - 1))
    starts = _album_starts(over, inner, run, rules)
    marked = chunked.joined(over, starts.withColumn("_start", F.lit(1)), [*run, "_pos"])
    numbered = chunked.running_sum(marked, inner, F.coalesce("_start", F.lit(0)), "album")
    return whole.unionByName(numbered.withColumn("album", F.col("album").cast("int")).drop("_start", "_pos"))


def _album_starts(over: DataFrame, inner: Line, run: list[str], rules: AlbumRules) -> DataFrame:
    """(run, _pos) of the messages that start an album."""
    photo = F.col("kind") == "image"
    size = F.when(photo, F.coalesce("bytes", F.lit(0))).otherwise(0)
    named = chunked.running_sum(over, inner, photo.cast("long"), "_photos")
    named = chunked.running_sum(named, inner, size, "_bytes")
    named = chunked.previous(named, inner, F.col("ts_s"), "_last_ts").withColumn("run", F.struct(*run))
    sizes = named.groupBy("run").agg(F.count(F.lit(1)).alias("_size"))
    points = cut_lineage(named.join(sizes, "run").select(
        "run", F.col("_pos").alias("pos"), "_size", "ts_s", "_last_ts", F.col("_photos").alias("photos"),
        F.when(photo, F.col("_bytes")).alias("used"), (F.col("_photos") - photo.cast("long")).alias("photos_before"),
        (F.col("_bytes") - size).alias("used_before")))
    # the last message before this one from which it is no idle time away: mostly the one just before, else searched
    # for, on the run turned round
    late = points.where("pos > 0").where(F.col("ts_s") - F.col("_last_ts") > rules.idle_s)
    near = F.col("pos") - 1
    if late.limit(1).count():  # arrivals out of order
        def turned(df: DataFrame) -> DataFrame:
            return df.select("run", (F.col("_size") - 1 - F.col("pos")).alias("pos"), "ts_s", F.col("ts_s").alias("own_ts"))

        far = jumps.first_beyond(turned(points), turned(late), ["run"],
                                 [jumps.Limit("ts_s", "own_ts", -rules.idle_s, or_equal=True)])
        far = far.join(sizes, "run").select("run", (F.col("_size") - 1 - F.col("pos")).alias("pos"), F.lit(True).alias("_far"),
                                            (F.col("_size") - 1 - F.col("found")).alias("_near"))
        points = points.join(far, ["run", "pos"], "left")
        near = F.when(F.coalesce("_far", F.lit(False)), F.col("_near")).otherwise(near)
    points = points.withColumn("no_nearer", F.coalesce(-near, F.lit(1))).withColumn("minus_pos", -F.col("pos"))
    limits = [jumps.Limit("no_nearer", "minus_pos", 0), jumps.Limit("ts_s", "first_ts", rules.span_s),
              jumps.Limit("photos", "photos_before", rules.max_images), jumps.Limit("used", "used_before", rules.max_bytes)]
    tried = points.withColumn("first_ts", F.col("ts_s"))
    pointers = jumps.first_beyond(points, tried.select("run", "pos", "minus_pos", "first_ts", "photos_before", "used_before"),
                                  ["run"], limits)
    found = jumps.reached(pointers.select("run", "pos", "found"), ["run"])
    return found.select(*[F.col(f"run.{c}").alias(c) for c in run], F.col("pos").alias("_pos"))


def album_table(numbered: DataFrame, order: list[Column]) -> DataFrame:
    """One row per album: bounds, counts, whether it holds a usable photo, and the key of its first message."""
    place = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    photo = F.col("kind") == "image"
    return numbered.groupBy("chat", "sender", "island", "album").agg(
        F.min_by("key", place).alias("album_key"), F.min_by("ts_s", place).alias("first_ts"),
        F.max("ts_s").alias("last_ts"), F.min(place).alias("first_place"), F.count(F.lit(1)).alias("n_messages"),
        F.count_if(photo).alias("n_images"), F.sum(F.when(photo, F.col("bytes")).otherwise(0)).alias("total_bytes"),
        F.bool_or(photo & ~F.col("missing")).alias("usable"))


def group_albums(msgs: DataFrame, line: Line, rules: AlbumRules = AlbumRules()) -> DataFrame:
    """Messages of albums that hold a usable photo, each with its `album_key`."""
    numbered = number_albums(msgs, line, rules)
    album = Window.partitionBy("chat", "sender", "island", "album")
    arrival = album.orderBy(*line.order).rowsBetween(Window.unboundedPreceding, 0)
    usable = F.bool_or((F.col("kind") == "image") & ~F.col("missing")).over(album)
    return (numbered.withColumn("album_key", F.first("key").over(arrival))
            .withColumn("first_ts", F.first("ts_s").over(arrival)).withColumn("_usable", usable)
            .where("_usable").drop("_usable"))


def dropped_albums(albums: DataFrame) -> DataFrame:
    reason = F.when(F.col("n_images") > 0, "dropped_all_missing").otherwise("dropped_text_only")
    return albums.where(~F.col("usable")).groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def cap_messages(msgs: DataFrame, post: list[str], limit: int = 60) -> DataFrame:
    """At most `limit` messages per post: every photo stays, then the earliest texts fill up. Expects kind, seq."""
    from bazaarlens.sources.tables import first_rows
    images = msgs.where(F.col("kind") == "image")
    counts = images.groupBy(*post).agg(F.count(F.lit(1)).alias("_images"))
    texts = first_rows(msgs.where(F.col("kind") == "text"), post, [F.col("seq")], limit, "_rn")
    room = F.lit(limit) - F.coalesce(F.col("_images"), F.lit(0))
    kept = texts.join(counts, post, "left").where(F.col("_rn") <= room).drop("_rn", "_images")
    return images.unionByName(kept)


def sliding_quota(hits: DataFrame, line: Line, at_us: str, *, limit: int, window_s: int) -> DataFrame:
    """Adds `admitted` and `retry_after` (seconds, 0 when admitted): at most `limit` admitted hits in a trailing
    window; refused hits do not count.

    A hit with at most `limit` hits of any kind in its window is admitted outright. Only stretches where that fails
    are folded, together with the quiet hits of the window before them; two stretches a window apart are independent."""
    width = window_s * MICROS
    at = F.col(at_us)
    counted = chunked.trailing_count(hits, line.keys, at, width, "_n")
    loud = F.col("_n") > limit
    seen = chunked.previous(counted, line.reversed(), F.when(loud, at), "_ahead", skip_nulls=True)
    near = loud | F.coalesce(F.col("_ahead") - at < width, F.lit(False))
    quiet = seen.where(~near).drop("_ahead", "_n")
    busy = chunked.previous(seen.where(near), line, at, "_before")
    cut = F.when(F.col("_before").isNull() | (at - F.col("_before") >= width), 1).otherwise(0)
    busy = chunked.running_sum(busy, line, cut, "_run").drop("_before", "_ahead", "_n")
    folded = fold_sorted(busy, [*line.keys, "_run"], line.order, quota_step(limit, width), [at_us],
                         [T.StructField("admitted", T.BooleanType()), T.StructField("_oldest", T.LongType())])
    wait = F.greatest(F.lit(1), F.ceil((F.col("_oldest") + width - at) / MICROS)).cast("long")
    answered = folded.withColumn("retry_after", F.when(F.col("admitted"), F.lit(0)).otherwise(wait).cast("long"))
    clear = quiet.withColumn("admitted", F.lit(True)).withColumn("retry_after", F.lit(0).cast("long"))
    return clear.unionByName(answered.drop("_run", "_oldest"))
