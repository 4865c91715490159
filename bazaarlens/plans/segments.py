"""Segment queries over conversations (posts) and event photos."""

from __future__ import annotations

from pyspark.sql import functions as F

from bazaarlens.functions.geometry import primary_box as box_of
from bazaarlens.operators import segments as op
from bazaarlens.plans.registry import query
from bazaarlens.sources import tables as t

RUNS = r"""
    WITH photos AS (
      SELECT post_id, seq, caption, CASE WHEN NOT missing THEN message_id END AS image_id,
             CASE WHEN regexp_matches(caption, '[\p{L}\p{N}]')
                  THEN lower(trim(regexp_replace(nfc_normalize(caption), '\s+', ' ', 'g'))) END AS form
      FROM v_post_messages WHERE kind = 'image'),
    flagged AS (
      SELECT *, form IS NOT NULL AND form IS DISTINCT FROM
                last_value(form IGNORE NULLS) OVER (PARTITION BY post_id ORDER BY seq
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS starts FROM photos),
    runs AS (
      SELECT *, greatest(1, sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER (PARTITION BY post_id ORDER BY seq)) AS run
      FROM flagged),
    segs AS (
      SELECT post_id, run, count(image_id) AS n, max(CASE WHEN starts THEN trim(caption) END) AS segment_caption
      FROM runs GROUP BY post_id, run)
"""


def _posts(spark, folder):
    m = t.post_messages(spark, folder)
    usable = (F.col("kind") == "image") & ~F.col("missing")
    return m.select("post_id", "seq", "kind", "caption", F.when(usable, F.col("message_id")).alias("image_id"))


def boxed_images(spark, folder):
    shaped = t.images(spark, folder).withColumn("_p", box_of(F.col("dets"), F.col("width"), F.col("height")))
    return (shaped.withColumn("box", F.col("_p.box")).withColumn("multi_item", F.col("_p.multi_item"))
            .withColumn("best_conf", F.array_max(F.transform("dets", lambda d: d["conf"]))).drop("_p"))


@query("segment_posts", RUNS + """
    SELECT r.post_id, r.image_id, s.segment_idx, s.segment_caption
    FROM runs r JOIN (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY run) - 1 AS segment_idx
                      FROM segs WHERE n > 0) s ON s.post_id = r.post_id AND s.run = r.run
    WHERE r.image_id IS NOT NULL""", ("v_post_messages",))
def segment_posts(spark, folder):
    return op.segment_posts(_posts(spark, folder)).select("post_id", "image_id", "segment_idx", "segment_caption")


@query("post_extra_text", RUNS + """
    SELECT post_id, string_agg(text, chr(10) ORDER BY part, pos) AS extra_text
    FROM (SELECT post_id, 0 AS part, seq AS pos, trim(caption) AS text FROM v_post_messages
          WHERE kind = 'text' AND trim(caption) <> ''
          UNION ALL SELECT post_id, 1, run, segment_caption FROM segs WHERE n = 0 AND segment_caption <> '')
    GROUP BY post_id""", ("v_post_messages",))
def post_extra_text(spark, folder):
    return op.post_extra_text(_posts(spark, folder)).select("post_id", "extra_text")


@query("primary_box", """
    SELECT image_id, multi_item, CASE WHEN box IS NULL THEN NULL ELSE
           array_to_string(list_transform(box, lambda x: CAST(CAST(x AS INTEGER) AS VARCHAR)), ',') END AS box
    FROM v_boxed""", ("v_boxed",))
def primary_box(spark, folder):
    return boxed_images(spark, folder).select(
        "image_id", "multi_item", F.array_join(F.col("box").cast("array<string>"), ",").alias("box"))


@query("pick_crops", """
    SELECT image_id, rank FROM (
      SELECT *, bool_or(box IS NOT NULL) OVER (PARTITION BY post_id, segment_idx) AS any_boxed
      FROM (SELECT *, row_number() OVER (PARTITION BY post_id, segment_idx
                ORDER BY box IS NULL, CASE WHEN box IS NOT NULL THEN -best_conf END, seq) AS rank FROM v_boxed)
      WHERE rank <= 4)
    WHERE box IS NOT NULL OR segment_idx % 2 = 0 OR NOT any_boxed""", ("v_boxed",))
def pick_crops(spark, folder):
    images = boxed_images(spark, folder).withColumn("need_size", F.col("segment_idx") % 2 == 0)
    return op.pick_crops(images, ["post_id", "segment_idx"]).select("image_id", "rank")


@query("first_tag_hit", """
    SELECT post_id, segment_idx, coalesce(have_brand, CASE WHEN reach THEN tag_brand END) AS brand,
           CAST(coalesce(have_size, tag_size) AS DOUBLE) AS size,
           CASE WHEN have_brand IS NULL AND reach AND tag_brand IS NOT NULL THEN 'ocr' END AS brand_source,
           CASE WHEN have_size IS NULL AND tag_size IS NOT NULL THEN 'ocr' END AS size_source
    FROM (SELECT *, have_size IS NOT NULL OR size_at IS NULL OR brand_at <= size_at AS reach FROM (
      SELECT post_id, segment_idx, CASE WHEN post_id % 3 = 0 THEN 'Nike' END AS have_brand,
             CASE WHEN post_id % 4 = 0 THEN 42 END AS have_size,
             min(rank) FILTER (tag_size IS NOT NULL) AS size_at, min(rank) FILTER (tag_brand IS NOT NULL) AS brand_at,
             arg_min(tag_size, rank) FILTER (tag_size IS NOT NULL) AS tag_size,
             arg_min(tag_brand, rank) FILTER (tag_brand IS NOT NULL) AS tag_brand
      FROM (SELECT *, row_number() OVER (PARTITION BY post_id, segment_idx
              ORDER BY coalesce((box[3] - box[1]) * (box[4] - box[2]), 0) DESC, seq) AS rank FROM v_boxed)
      WHERE rank <= 4 GROUP BY post_id, segment_idx))""", ("v_boxed",))
def first_tag_hit(spark, folder):
    images = boxed_images(spark, folder).withColumn(
        "have_brand", F.when(F.col("post_id") % 3 == 0, "Nike")).withColumn(
        "have_size", F.when(F.col("post_id") % 4 == 0, F.lit(42).cast("decimal(4,1)")))
    hits = op.first_tag_hit(images, ["post_id", "segment_idx"])
    return hits.withColumn("size", F.col("size").cast("double"))


@query("cover_image", """
    SELECT post_id, segment_idx, first(image_id ORDER BY box IS NULL, seq) AS cover_image_id FROM v_boxed
    GROUP BY post_id, segment_idx""", ("v_boxed",))
def cover_image(spark, folder):
    return op.cover_image(boxed_images(spark, folder), ["post_id", "segment_idx"])


@query("post_bounds", """
    SELECT post_id, epoch_us(min(seen_at)) AS first_us, epoch_us(max(seen_at)) AS last_us FROM v_sighting
    GROUP BY post_id""", ("v_sighting",))
def post_bounds(spark, folder):
    bounds = op.post_bounds(t.sightings(spark, folder), ["post_id"], "seen_at")
    return bounds.select("post_id", F.unix_micros("first_msg_at").alias("first_us"),
                         F.unix_micros("last_msg_at").alias("last_us"))
