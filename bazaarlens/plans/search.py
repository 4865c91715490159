"""Search queries: ranked listings, feed pages, neighbours, votes and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from bazaarlens.functions.vectors import cosine as cosine_of
from bazaarlens.functions.vectors import unit
from bazaarlens.operators import matching as op
from bazaarlens.operators import reposts
from bazaarlens.plans.registry import query
from bazaarlens.sources import tables as t


def _query_vector(spark, folder):
    """The query vector as a one-row table: the first embedding."""
    e = t.load_table(spark, folder, "embeddings").where(F.col("vec_id") == 0)
    return e.select(F.col("embedding").alias("query_vec")).limit(1)


@query("search_listings", """
    SELECT listing_id, brand, CAST(size_eu AS DOUBLE) AS size_eu, price, fit, score FROM (
      SELECT *, CASE WHEN size_eu BETWEEN 20 AND 24 THEN 0 WHEN size_eu IS NOT NULL THEN 1 ELSE 2 END AS fit,
             round(list_cosine_similarity(embedding, (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)),
                   6) AS score
      FROM v_listing_vec
      WHERE status = 'active' AND (source = 'demo_seed' OR owner_session = 'u1')
        AND (size_eu IS NULL OR size_eu BETWEEN 20 - (CASE WHEN size_source = 'vlm' THEN 1 ELSE 0 END)
                                            AND 24 + (CASE WHEN size_source = 'vlm' THEN 1 ELSE 0 END))
        AND (price IS NULL OR price <= 990))
    ORDER BY fit, score DESC, listing_id DESC LIMIT 48""", ("v_listing_vec",))
def search_listings(spark, folder):
    rows = t.listings(spark, folder).join(F.broadcast(_query_vector(spark, folder)))  # one row
    found = op.search_listings(rows, vector=F.col("query_vec"), size_min=20, size_max=24, max_price=990, owner="u1")
    return found.select("listing_id", "brand", F.col("size_eu").cast("double").alias("size_eu"), "price", "fit", "score")


@query("search_newest", """
    SELECT listing_id, fit, epoch_us(last_seen) AS seen_us FROM (
      SELECT *, CASE WHEN size_eu BETWEEN 30 AND 30 THEN 0 WHEN size_eu IS NOT NULL THEN 1 ELSE 2 END AS fit
      FROM v_listing WHERE status = 'active' AND lower(brand) = 'brand#3'
        AND (size_eu IS NULL OR size_eu BETWEEN 30 - (CASE WHEN size_source = 'vlm' THEN 1 ELSE 0 END)
                                            AND 30 + (CASE WHEN size_source = 'vlm' THEN 1 ELSE 0 END)))
    ORDER BY fit, last_seen DESC, listing_id DESC LIMIT 48""", ("v_listing",))
def search_newest(spark, folder):
    """A filters-only query has no vector: newest first."""
    rows = t.listings(spark, folder, with_vector=False)
    found = op.search_listings(rows, size_min=30, size_max=30, brand="Brand#3")
    return found.select("listing_id", "fit", F.unix_micros("last_seen").alias("seen_us"))


@query("photo_search", """
    SELECT vec_id, listing_id, cos, place FROM (
      SELECT q.vec_id, l.listing_id, round(list_cosine_similarity(q.embedding, l.embedding), 6) AS cos,
             row_number() OVER (PARTITION BY q.vec_id
               ORDER BY round(list_cosine_similarity(q.embedding, l.embedding), 6) DESC, l.listing_id DESC) AS place
      FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings) q
      JOIN v_listing_vec l ON l.status = 'active')
    WHERE place <= 24""", ("v_listing_vec",))
def photo_search(spark, folder):
    """Every embedding as a photo query: its 24 most similar active listings."""
    photos = t.load_table(spark, folder, "embeddings").select("vec_id", F.col("embedding").alias("query_vec"))
    listings = t.listings(spark, folder).where(F.col("status") == "active")
    return op.nearest(photos, listings, 24, query_id="vec_id", descending_id=True)


@query("feed_page", """
    SELECT listing_id, epoch_us(last_seen) AS seen_us FROM v_listing
    WHERE status = 'active' AND (last_seen < TIMESTAMP '2024-02-10' OR (last_seen = TIMESTAMP '2024-02-10'
                                                                      AND listing_id < 1000))
    ORDER BY last_seen DESC, listing_id DESC LIMIT 24""", ("v_listing",))
def feed_page(spark, folder):
    rows = t.listings(spark, folder, with_vector=False)
    page = op.feed_page(rows, cursor=(F.lit("2024-02-10 00:00:00").cast("timestamp"), F.lit(1000)))
    return page.select("listing_id", F.unix_micros("last_seen").alias("seen_us"))


@query("cosine", """
    SELECT listing_id, round(list_cosine_similarity(embedding,
             (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)), 6) AS cos
    FROM v_listing_vec""", ("v_listing_vec",))
def cosine(spark, folder):
    rows = t.listings(spark, folder).join(F.broadcast(_query_vector(spark, folder)))  # one row
    return rows.select("listing_id", F.round(cosine_of(F.col("embedding"), F.col("query_vec")), 6).alias("cos"))


NEIGHBOURS_SQL = """
    SELECT * FROM (
      SELECT q.vec_id, l.listing_id, l.brand, round(list_cosine_similarity(q.embedding, l.embedding), 6) AS cos,
             row_number() OVER (PARTITION BY q.vec_id
               ORDER BY round(list_cosine_similarity(q.embedding, l.embedding), 6) DESC, l.listing_id) AS place
      FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS embedding, 'u' || (vec_id % 4) AS session FROM embeddings) q
      JOIN v_listing_vec l ON l.post_id <> q.vec_id * 10 AND l.brand_source IN ('caption', 'ocr', 'vlm', 'seed')
           AND (l.owner_session IS NULL OR l.owner_session = q.session))
    WHERE place <= 5"""


def _photos(spark, folder):
    return t.load_table(spark, folder, "embeddings").select(
        "vec_id", F.col("embedding").alias("query_vec"), (F.col("vec_id") * 10).alias("post"),
        F.concat(F.lit("u"), (F.col("vec_id") % 4).cast("string")).alias("session"))


def _coarse_brands(spark, folder):
    """Listings under three brand names, so that a majority among five neighbours exists."""
    rows = t.listings(spark, folder)
    return rows.withColumn("brand", F.concat(F.lit("B"), (F.col("listing_id") % 3).cast("string")))


@query("knn_brand", f"""
    SELECT n.vec_id, n.brand, n.votes, m.top_cos
    FROM (SELECT vec_id, 'B' || (listing_id % 3) AS brand, count(*) AS votes FROM ({NEIGHBOURS_SQL}) GROUP BY 1, 2) n
    JOIN (SELECT vec_id, max(cos) AS top_cos FROM ({NEIGHBOURS_SQL}) GROUP BY 1) m ON m.vec_id = n.vec_id
    WHERE n.votes >= 3 AND m.top_cos >= 0.35""", ("v_listing_vec",))
def knn_brand(spark, folder):
    return op.knn_brand(_photos(spark, folder), _coarse_brands(spark, folder), query_id="vec_id", query_post="post",
                        query_session="session", min_cos=0.35)


@query("brand_vote", """
    SELECT seller, brand, count(*) AS votes FROM v_listing GROUP BY seller, brand HAVING count(*) >= 3""",
       ("v_listing",))
def brand_vote(spark, folder):
    return op.brand_vote(t.listings(spark, folder, with_vector=False), "seller")


@query("zero_shot_label", """
    WITH RECURSIVE mean AS (
      SELECT label, pos, avg(v) AS m FROM (
        SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS v, unnest(range(len(embedding))) AS pos FROM embeddings)
      GROUP BY label, pos),
    labels AS (SELECT label, list(m ORDER BY pos) AS label_vec FROM mean GROUP BY label),
    scored AS (
      SELECT e.vec_id, l.label, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), l.label_vec), 6) AS cos
      FROM embeddings e, labels l),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY cos DESC, label) AS place FROM scored)
    SELECT vec_id, max(label) FILTER (place = 1) AS label, max(cos) FILTER (place = 1) AS top,
           max(cos) FILTER (place = 2) AS second
    FROM ranked GROUP BY vec_id
    HAVING max(cos) FILTER (place = 1) >= 0.08
       AND round(max(cos) FILTER (place = 1) - max(cos) FILTER (place = 2), 6) >= 0.03""")
def zero_shot_label(spark, folder):
    """Label vectors are the unit means of the labelled embeddings."""
    e = t.load_table(spark, folder, "embeddings")
    labels = reposts.segment_embedding(e, ["label"], "embedding").withColumnRenamed("embedding", "label_vec")
    return op.zero_shot_label(e, labels, item_id="vec_id", vector="embedding")


@query("unit_vector", """
    SELECT vec_id, round(sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))), 6) AS length_before,
           1.0::DOUBLE AS length_after FROM embeddings""")
def unit_vector(spark, folder):
    e = t.load_table(spark, folder, "embeddings").withColumn("u", unit(F.transform("embedding", lambda x: x * 3)))
    square = lambda acc, x: acc + x.cast("double") * x.cast("double")
    return e.select("vec_id", F.round(F.sqrt(F.aggregate("embedding", F.lit(0.0), square)), 6).alias("length_before"),
                    F.round(F.sqrt(F.aggregate("u", F.lit(0.0), square)), 6).alias("length_after"))
