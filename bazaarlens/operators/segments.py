"""Posts into items: caption runs, segment text, crops, tags, covers and boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bazaarlens.functions import text as tx
from bazaarlens.functions.geometry import pixel_area
from bazaarlens.operators import chunked
from bazaarlens.operators.chunked import Line

from bazaarlens.sources.tables import first_rows

MAX_SEGMENT_IMAGES = 4


def strip(text: Column) -> Column:
    return F.regexp_replace(text, tx.U + r"^\s+|\s+$", "")


def is_captioned(caption: Column) -> Column:
    return F.coalesce(caption.rlike(r"[\p{L}\p{N}]"), F.lit(False))


def post_line(msgs: DataFrame) -> Line:
    return Line(["post_id"], [F.col("seq")], chunked.by_rows(F.col("seq")))


def image_runs(msgs: DataFrame, line: Line) -> DataFrame:
    """Photos with `run`: a captioned photo whose caption differs from the last captioned one starts a run; photos
    before the first caption belong to run 1. Expects post_id, seq, kind, caption, image_id (null when missing)."""
    photos = msgs.where(F.col("kind") == "image").withColumn(
        "_form", F.when(is_captioned(F.col("caption")), tx.caption_form(F.col("caption"))))
    seen = chunked.previous(photos, line, F.col("_form"), "_last", skip_nulls=True)
    starts = F.col("_form").isNotNull() & ~F.col("_form").eqNullSafe(F.col("_last"))
    runs = chunked.running_sum(seen.withColumn("_start", starts), line, F.col("_start").cast("int"), "_runs")
    return (runs.withColumn("run", F.greatest(F.col("_runs"), F.lit(1)))
            .withColumn("run_caption", F.when(F.col("_start"), strip(F.col("caption"))))
            .drop("_form", "_last", "_runs", "_start"))


def run_table(runs: DataFrame) -> DataFrame:
    """One row per (post, run): caption and number of usable photos."""
    return runs.groupBy("post_id", "run").agg(
        F.max("run_caption").alias("segment_caption"), F.count("image_id").alias("n_images"))


def number_segments(table: DataFrame) -> DataFrame:
    """Dense 0-based `segment_idx` over the runs that have a usable photo."""
    line = Line(["post_id"], [F.col("run")], chunked.by_rows(F.col("run")))
    kept = chunked.row_number(table.where("n_images > 0"), line, "_place")
    return kept.withColumn("segment_idx", F.col("_place") - 1).drop("_place")


def segment_posts(msgs: DataFrame, line: Line | None = None) -> DataFrame:
    """One row per usable photo: its segment and the segment's caption."""
    line = line or post_line(msgs)
    runs = image_runs(msgs, line)
    segments = number_segments(run_table(runs)).select("post_id", "run", "segment_idx", "segment_caption")
    usable = runs.where(F.col("image_id").isNotNull()).drop("caption", "run_caption", "kind")
    return usable.join(segments, ["post_id", "run"]).drop("run")


def post_extra_text(msgs: DataFrame, line: Line | None = None) -> DataFrame:
    """One row per post with text outside its segments: text messages by position, then the captions of runs that
    kept no photo, all of them. The text of one post is one value, so its pieces meet in one row."""
    said = msgs.where((F.col("kind") == "text") & (strip(F.col("caption")) != "")).select(
        "post_id", F.lit(0).alias("part"), F.col("seq").cast("long").alias("at"), strip(F.col("caption")).alias("text"))
    lost = run_table(image_runs(msgs, line or post_line(msgs))).where("n_images = 0 AND segment_caption <> ''").select(
        "post_id", F.lit(1).alias("part"), F.col("run").cast("long").alias("at"),
        F.col("segment_caption").alias("text"))
    joined = said.unionByName(lost).groupBy("post_id").agg(
        F.sort_array(F.collect_list(F.struct("part", "at", "text"))).alias("_p"))
    return joined.select("post_id", F.array_join("_p.text", "\n").alias("extra_text"))


def pick_crops(images: DataFrame, segment: list[str], limit: int = MAX_SEGMENT_IMAGES) -> DataFrame:
    """At most `limit` photos per segment with their rank: boxed ones by confidence, then unboxed ones by position if
    the size is missing or nothing was boxed. Expects seq, box, best_conf, need_size."""
    order = [F.col("box").isNull(), F.when(F.col("box").isNotNull(), -F.coalesce("best_conf", F.lit(0.0))),
             F.col("seq")]
    ranked = first_rows(images, segment, order, limit, "rank")
    any_boxed = F.max(F.col("box").isNotNull()).over(Window.partitionBy(*segment))
    return (ranked.withColumn("_boxed", any_boxed)
            .where(F.col("box").isNotNull() | F.col("need_size") | ~F.col("_boxed")).drop("_boxed"))


def first_tag_hit(images: DataFrame, segment: list[str], limit: int = MAX_SEGMENT_IMAGES) -> DataFrame:
    """Brand and size per segment from its photos' tags, largest box first, stopping at the photo that gives the
    needed one: the size where it is missing, else the brand. Expects seq, box, tag_brand, tag_size, have_brand,
    have_size (the segment's own values or null)."""
    ranked = first_rows(images, segment, [pixel_area(F.col("box")).desc(), F.col("seq")], limit, "rank")
    sized, branded = F.col("tag_size").isNotNull(), F.col("tag_brand").isNotNull()
    found = ranked.groupBy(*segment).agg(
        F.min("have_brand").alias("have_brand"), F.min("have_size").alias("have_size"),
        F.min(F.when(sized, F.col("rank"))).alias("_size_at"), F.min(F.when(branded, F.col("rank"))).alias("_brand_at"),
        F.min_by("tag_size", F.when(sized, F.col("rank"))).alias("_size"),
        F.min_by("tag_brand", F.when(branded, F.col("rank"))).alias("_brand"))
    in_reach = F.col("have_size").isNotNull() | F.col("_size_at").isNull() | (F.col("_brand_at") <= F.col("_size_at"))
    return found.select(
        *segment, F.coalesce("have_brand", F.when(in_reach, F.col("_brand"))).alias("brand"),
        F.coalesce("have_size", "_size").alias("size"),
        F.when(F.col("have_brand").isNull() & in_reach & F.col("_brand").isNotNull(), "ocr").alias("brand_source"),
        F.when(F.col("have_size").isNull() & F.col("_size").isNotNull(), "ocr").alias("size_source"))


def cover_image(images: DataFrame, segment: list[str]) -> DataFrame:
    """The first boxed photo, else the first."""
    return images.groupBy(*segment).agg(
        F.min_by("image_id", F.struct(F.col("box").isNull(), F.col("seq"))).alias("cover_image_id"))


def post_bounds(msgs: DataFrame, post: list[str], at: str) -> DataFrame:
    return msgs.groupBy(*post).agg(F.min(at).alias("first_msg_at"), F.max(at).alias("last_msg_at"))
