"""Repost queries: hash and embedding resolution, folding, review samples and clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from bazaarlens.operators import reposts as op
from bazaarlens.plans.registry import query
from bazaarlens.sources import tables as t

HAMMING = "bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo))"


def _dated(images):
    """Known photos with their listing's owner and time."""
    return images.withColumn("owner", F.lit(None).cast("string")).withColumn(
        "last_seen", F.timestamp_seconds(F.lit(1704067200) + F.col("listing_id") % 200 * 86400))


@query("repost_by_hash", f"""
    SELECT post_id, listing_id, 1 AS matched FROM (
      SELECT a.post_id, b.listing_id, row_number() OVER (PARTITION BY a.post_id ORDER BY b.listing_id) AS rn
      FROM v_doc_image a JOIN v_doc_image b ON a.post_id <> b.post_id AND {HAMMING} <= 2
      WHERE b.listing_id % 200 > a.post_id % 200 - 90) WHERE rn = 1""", ("v_doc_image",))
def repost_by_hash(spark, folder):
    """Every text against every other: the earliest known listing within two bits and the window."""
    images = t.doc_images(spark, folder)
    new = images.select("post_id", F.lit(0).alias("segment_idx"), "phash", "seller",
                        F.lit(None).cast("string").alias("owner"),
                        F.timestamp_seconds(F.lit(1704067200) + F.col("post_id") % 200 * 86400).alias("ref_time"))
    return op.repost_by_hash(new, _dated(images)).select("post_id", "listing_id", "matched")


@query("repost_by_embedding", """
    SELECT post_id, listing_id, cos FROM (
      SELECT a.post_id, b.listing_id, round(list_cosine_similarity(a.embedding, b.embedding), 6) AS cos,
             row_number() OVER (PARTITION BY a.post_id
               ORDER BY round(list_cosine_similarity(a.embedding, b.embedding), 6) DESC, b.listing_id) AS rn
      FROM v_listing_vec a JOIN v_listing_vec b ON a.seller = b.seller AND a.post_id <> b.post_id
           AND b.last_seen > a.last_seen - INTERVAL 40 DAY) WHERE rn = 1 AND cos >= 0.96""", ("v_listing_vec",))
def repost_by_embedding(spark, folder):
    rows = t.listings(spark, folder)
    new = rows.select("post_id", "segment_idx", "seller", F.col("last_seen").alias("ref_time"), "embedding")
    return op.repost_by_embedding(new, rows, window_days=40).select("post_id", "listing_id", "cos")


def _fold_input(spark, folder):
    s = t.sightings(spark, folder)
    order = [F.col(c) for c in ("seen_at", "listing_id", "price", "suppkey", "qty", "match_kind")]
    lid = F.col("listing_id")
    facts = s.withColumns({
        "brand": F.when(F.col("qty") % 3 == 0, F.concat(F.lit("S"), F.col("qty").cast("string"))),
        "size_label": F.when(F.col("qty") % 4 == 0, F.concat(F.lit("EU "), F.col("qty").cast("string"))),
        "size_eu": F.when(F.col("qty") % 4 == 0, F.col("qty").cast("decimal(4,1)")),
        "currency": F.when(F.col("qty") % 5 == 0, "PKR"), "price_on_request": F.col("qty") == 50,
        "size_approx": F.col("qty") % 8 == 0, "source": F.col("match_kind"), "price": F.when(F.col("qty") % 2 == 0, F.col("price"))})
    base = t.listings(spark, folder, with_vector=False).select(
        "listing_id", F.when(lid % 3 == 0, F.col("brand")).alias("brand"), "brand_source",
        F.when(lid % 4 == 0, F.lit("EU 40")).alias("size_label"), F.when(lid % 4 == 0, F.lit(40).cast("decimal(4,1)"))
        .alias("size_eu"), F.when(lid % 4 == 0, False).alias("size_approx"), "size_source",
        F.when(lid % 6 != 0, F.col("price")).cast("double").alias("price"),
        F.when(lid % 6 != 0, "caption").alias("price_source"), "currency", F.lit(False).alias("price_on_request"),
        F.lit(0).alias("repost_count"), F.col("last_seen").alias("first_seen"), "last_seen")
    return base, op.new_sightings(facts, None, [F.col(c) for c in ("seen_at", "listing_id", "suppkey", "qty")]), order


FOLD_PLACE = "seen_at, listing_id, price, suppkey, qty, match_kind"


@query("repost_fold", f"""
    WITH facts AS (
      SELECT *, CASE WHEN qty % 3 = 0 THEN 'S' || qty END AS s_brand, CASE WHEN qty % 4 = 0 THEN 'EU ' || qty END AS s_size,
             CASE WHEN qty % 5 = 0 THEN 'PKR' END AS s_currency, CASE WHEN qty % 2 = 0 THEN price END AS s_price
      FROM v_sighting
      QUALIFY row_number() OVER (PARTITION BY post_id, segment_idx ORDER BY seen_at, listing_id, suppkey, qty) = 1),
    folded AS (
      SELECT listing_id, max(seen_at) AS last_at, min(seen_at) AS first_at, count(*) AS n,
             last(s_price ORDER BY {FOLD_PLACE}) FILTER (s_price IS NOT NULL) AS s_price,
             first(s_brand ORDER BY {FOLD_PLACE}) FILTER (s_brand IS NOT NULL) AS s_brand,
             first(s_size ORDER BY {FOLD_PLACE}) FILTER (s_size IS NOT NULL) AS s_size,
             first(s_currency ORDER BY {FOLD_PLACE}) FILTER (s_currency IS NOT NULL) AS s_currency,
             last(match_kind ORDER BY {FOLD_PLACE}) FILTER (s_price IS NOT NULL) AS s_price_source,
             first(qty % 8 = 0 ORDER BY {FOLD_PLACE}) FILTER (s_size IS NOT NULL) AS s_approx,
             bool_or(qty = 50) AS on_request, first(match_kind ORDER BY {FOLD_PLACE}) FILTER (qty = 50) AS s_asked
      FROM facts GROUP BY listing_id)
    SELECT l.listing_id, coalesce(f.n, 0) AS repost_count, epoch_us(greatest(l.last_seen, f.last_at)) AS last_us,
           epoch_us(least(l.last_seen, f.first_at)) AS first_us,
           coalesce(f.s_price, CASE WHEN l.listing_id % 6 <> 0 THEN CAST(l.price AS DOUBLE) END) AS price,
           coalesce(f.s_price_source, CASE WHEN l.listing_id % 6 <> 0 THEN 'caption' END, f.s_asked) AS price_source,
           CASE WHEN l.listing_id % 4 = 0 THEN false ELSE f.s_approx END AS size_approx,
           coalesce(CASE WHEN l.listing_id % 3 = 0 THEN l.brand END, f.s_brand) AS brand,
           coalesce(CASE WHEN l.listing_id % 4 = 0 THEN 'EU 40' END, f.s_size) AS size_label,
           coalesce(l.currency, f.s_currency) AS currency, coalesce(f.on_request, false) AS price_on_request
    FROM v_listing l LEFT JOIN folded f ON f.listing_id = l.listing_id""", ("v_listing", "v_sighting"))
def repost_fold(spark, folder):
    base, facts, order = _fold_input(spark, folder)
    folded = op.repost_fold(base, facts, order)
    return folded.select("listing_id", "repost_count", F.unix_micros("last_seen").alias("last_us"),
                         F.unix_micros("first_seen").alias("first_us"), "price", "price_source", "brand",
                         "size_label", "size_approx", "currency", "price_on_request")


@query("segment_embedding", """
    WITH mean AS (
      SELECT label, pos, avg(v) AS m FROM (
        SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS v, unnest(range(len(embedding))) AS pos FROM embeddings)
      GROUP BY label, pos)
    SELECT label, round(max(CASE WHEN pos = 0 THEN m END) / sqrt(sum(m * m)), 6) AS first,
           round(max(CASE WHEN pos = 63 THEN m END) / sqrt(sum(m * m)), 6) AS last,
           round(sum(m) / sqrt(sum(m * m)), 6) AS total FROM mean GROUP BY label""")
def segment_embedding(spark, folder):
    """The unit mean vector per label: its ends and its sum."""
    means = op.segment_embedding(t.load_table(spark, folder, "embeddings"), ["label"], "embedding")
    v = F.col("embedding")
    return means.select("label", F.round(F.element_at(v, 1), 6).alias("first"),
                        F.round(F.element_at(v, -1), 6).alias("last"),
                        F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("pair_self_join", f"""
    SELECT distance, same_seller, count(*) AS pairs FROM (
      SELECT {HAMMING} AS distance, a.seller = b.seller AS same_seller
      FROM v_doc_image a JOIN v_doc_image b ON a.post_id < b.post_id)
    WHERE (same_seller AND distance IN (2, 4, 6, 8, 10)) OR (NOT same_seller AND distance IN (2, 4))
    GROUP BY distance, same_seller""", ("v_doc_image",))
def pair_self_join(spark, folder):
    counted = op.hash_distance_bands(t.doc_images(spark, folder))
    return counted.select(F.col("distance").cast("long").alias("distance"), "same_seller", "pairs")


@query("pair_cosine_bands", """
    SELECT CASE WHEN cos < 0.91 THEN 0.88 WHEN cos < 0.93 THEN 0.91 WHEN cos < 0.94 THEN 0.93 ELSE 0.94 END::DOUBLE
           AS cos_from, count(*) AS pairs
    FROM (SELECT round(list_cosine_similarity(a.embedding, b.embedding), 6) AS cos
          FROM v_listing_vec a JOIN v_listing_vec b ON a.seller = b.seller AND a.post_id < b.post_id)
    WHERE cos >= 0.88 GROUP BY 1""", ("v_listing_vec",))
def pair_cosine_bands(spark, folder):
    return op.cosine_bands(t.listings(spark, folder))


@query("stratified_pairs", f"""
    SELECT distance, same_seller, left_id, right_id, place FROM (
      SELECT *, row_number() OVER (PARTITION BY distance, same_seller
                                   ORDER BY md5(left_id || ':' || right_id)) AS place
      FROM (SELECT {HAMMING} AS distance, a.seller = b.seller AS same_seller, a.post_id AS left_id, b.post_id AS right_id
            FROM v_doc_image a JOIN v_doc_image b ON a.post_id < b.post_id)
      WHERE (same_seller AND distance IN (2, 4, 6, 8, 10)) OR (NOT same_seller AND distance IN (2, 4)))
    WHERE place <= CASE WHEN same_seller THEN 10 ELSE 5 END""", ("v_doc_image",))
def stratified_pairs(spark, folder):
    pairs = op.stratified_pairs(t.doc_images(spark, folder), per_band=10)
    return pairs.select(F.col("distance").cast("long").alias("distance"), "same_seller", "left_id", "right_id", "place")


@query("repost_clusters", f"""
    WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    img AS MATERIALIZED (
      SELECT h.post_id, h.hi, h.lo, h.seller, h.post_id % 2 AS owner, h.post_id * 37 % 400 AS day, e.v
      FROM v_doc_image h LEFT JOIN e ON e.vec_id = h.post_id // 2 % (SELECT count(*) FROM embeddings)),
    edges AS MATERIALIZED (
      SELECT a.post_id AS x, b.post_id AS y FROM img a JOIN img b ON a.post_id <> b.post_id AND abs(a.day - b.day) < 90
       AND ((a.owner = b.owner AND {HAMMING} <= 2)
            OR (a.seller = b.seller AND round(list_cosine_similarity(a.v, b.v), 6) >= 0.96))),
    reach AS (
      SELECT post_id AS x, post_id AS y FROM img
      UNION
      SELECT r.x, e.y FROM reach r JOIN edges e ON e.x = r.y)
    SELECT x AS post_id, min(y) AS listing_id, count(*) AS n_posts FROM reach GROUP BY x""", ("v_doc_image",))
def repost_clusters(spark, folder):
    """Documents of two owners over 400 days, linked by hash or by vector."""
    docs = t.doc_images(spark, folder).withColumn("half", F.floor(F.col("post_id") / 2))
    rows = t.with_vectors(spark, folder, docs, "half", "embedding").select(
        "post_id", "phash", "seller", (F.col("post_id") % 2).cast("string").alias("owner"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("post_id") * 37 % 400 * 86400).alias("seen_at"), "embedding")
    return op.repost_clusters(rows)


@query("price_history", """
    SELECT listing_id, post_id, segment_idx, epoch_us(seen_at) AS seen_us, price, place, price_before FROM (
      SELECT *, row_number() OVER w AS place, lag(price) OVER w AS price_before FROM v_sighting
      WINDOW w AS (PARTITION BY listing_id ORDER BY seen_at, post_id, segment_idx, price, suppkey))
    """, ("v_sighting",))
def price_history(spark, folder):
    order = [F.col(c) for c in ("seen_at", "post_id", "segment_idx", "price", "suppkey")]
    rows = op.price_history(t.sightings(spark, folder), order)
    return rows.select("listing_id", "post_id", "segment_idx", F.unix_micros("seen_at").alias("seen_us"), "price",
                       "place", "price_before")
