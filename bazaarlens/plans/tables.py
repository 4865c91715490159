"""Table queries: base tables, sinks, joins over stored tables and maintenance."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from bazaarlens.functions.ids import content_hash
from bazaarlens.operators import maintenance as op
from bazaarlens.plans.registry import query
from bazaarlens.session import fresh_path
from bazaarlens.sources import files, sinks
from bazaarlens.sources import tables as t
from bazaarlens.sources.store import BucketTable

NOW = "2024-03-01 00:00:00"


def now():
    return F.lit(NOW).cast("timestamp")


@query("load_tables", " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n FROM {n}" for n in t.TABLES))
def load_tables(spark, folder):
    counted = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("name"), "n")
               for n, df in t.load_tables(spark, folder).items()]
    return functools.reduce(lambda a, b: a.unionByName(b), counted)


def posts(spark, folder):
    """Posts from orders."""
    n = F.col("o_orderkey")
    source = F.when(n % 4 == 0, "demo_seed").when(n % 4 == 1, "demo_upload").otherwise("chat_export")
    return t.load_table(spark, folder, "orders").select(
        n.alias("post_id"), source.alias("source"),
        F.when(n % 4 == 1, F.concat(F.lit("u"), (n % 3).cast("string"))).alias("owner_session"),
        F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "processing")
        .otherwise("failed").alias("status"), F.when(n % 2 == 0, "never").otherwise("auto").alias("vlm_policy"),
        F.lit("listed").alias("outcome"), F.col("o_orderdate").cast("timestamp").alias("created_at"))


POSTS = """
    posts AS (SELECT o_orderkey AS post_id, CASE o_orderkey % 4 WHEN 0 THEN 'demo_seed' WHEN 1 THEN 'demo_upload'
                     ELSE 'chat_export' END AS source,
                     CASE WHEN o_orderkey % 4 = 1 THEN 'u' || (o_orderkey % 3) END AS owner_session,
                     CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'processing' ELSE 'failed' END AS status,
                     CASE WHEN o_orderkey % 2 = 0 THEN 'never' ELSE 'auto' END AS vlm_policy, o_orderdate AS created_at
              FROM orders)"""


def photos(spark, folder):
    """Stored photos: an event photo belongs to the post and content its id names."""
    number = t.load_table(spark, folder, "orders").agg(F.max("o_orderkey").alias("_posts"))  # one row
    e = t.images(spark, folder).join(F.broadcast(number))
    n = F.col("image_id")
    return e.select(n, (n % F.col("_posts")).alias("post_id"), (n % 2).cast("int").alias("segment_idx"), "seq", "dets",
                    content_hash((n % 5000).cast("string")).alias("sha256"))


PHOTOS = """
    photos AS (SELECT event_id AS image_id, event_id % (SELECT max(o_orderkey) FROM orders) AS post_id, event_id % 2 AS segment_idx, event_id AS seq,
                      event_id % 5 AS n_dets, sha256(CAST(event_id % 5000 AS VARCHAR)) AS sha256 FROM events)"""


def stored_listings(spark, folder):
    """Listings whose post is the order of the same key."""
    n = F.col("listing_id")
    return t.listings(spark, folder, with_vector=False).withColumns({
        "post_id": n, "segment_idx": (n % 2).cast("int"), "item_idx": F.lit(0),
        "extraction": F.when(n % 3 == 0, "vlm").otherwise("local"), "cover_image_id": n * 3,
        "size_label": F.col("size_eu").cast("string"), "price_on_request": F.lit(False),
        "first_seen": F.col("last_seen")})


def blobs(spark, folder):
    """Stored blobs, half of them shown by photos."""
    n = F.col("o_orderkey")
    return t.load_table(spark, folder, "orders").select(
        content_hash((n * 2).cast("string")).alias("sha256"), F.col("o_orderdate").cast("timestamp").alias("created_at"))


BLOBS = "blobs AS (SELECT sha256(CAST(o_orderkey * 2 AS VARCHAR)) AS sha256, o_orderdate AS created_at FROM orders)"


@query("listing_with_cover", f"""
    WITH {PHOTOS}
    SELECT l.listing_id, i.sha256 AS cover_sha FROM v_listing l LEFT JOIN photos i ON i.image_id = l.listing_id * 3
    """, ("v_listing",))
def listing_with_cover(spark, folder):
    shown = op.listing_with_cover(stored_listings(spark, folder), photos(spark, folder))
    return shown.select("listing_id", "cover_sha")


PAGE = 20


@query("listing_detail", f"""
    WITH {PHOTOS},
    shown AS (SELECT listing_id, (n - 1) // {PAGE} AS page, string_agg(CAST(image_id AS VARCHAR), ',' ORDER BY n) AS images
              FROM (SELECT post_id AS listing_id, image_id, row_number() OVER (PARTITION BY post_id ORDER BY seq) AS n
                    FROM photos) GROUP BY ALL),
    seen AS (SELECT listing_id, (n - 1) // {PAGE} AS page, count(*) AS n_sightings,
                    md5(string_agg(match_kind || '@' || epoch_us(seen_at), ',' ORDER BY n)) AS sightings_md5
             FROM (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY seen_at, sighting_id) AS n
                   FROM (SELECT *, concat_ws('/', post_id, segment_idx, suppkey, qty, match_kind) AS sighting_id
                         FROM v_sighting)) GROUP BY ALL),
    nested AS (SELECT coalesce(a.listing_id, b.listing_id) AS listing_id, coalesce(a.page, b.page) AS page, images,
                      n_sightings, sightings_md5
               FROM shown a FULL JOIN seen b ON a.listing_id = b.listing_id AND a.page = b.page)
    SELECT l.listing_id, l.brand, coalesce(page, 0) AS page, images, n_sightings, sightings_md5
    FROM v_listing l LEFT JOIN nested n ON n.listing_id = l.listing_id""", ("v_listing", "v_sighting"))
def listing_detail(spark, folder):
    shown = photos(spark, folder).withColumn("listing_id", F.col("post_id"))
    seen = t.sightings(spark, folder).withColumn(
        "sighting_id", F.concat_ws("/", "post_id", "segment_idx", "suppkey", "qty", "match_kind"))
    detail = op.listing_detail(t.listings(spark, folder, with_vector=False), shown, seen, page_size=PAGE)
    told = F.transform("sightings", lambda s: F.concat(
        s["match_kind"], F.lit("@"), F.unix_micros(s["seen_at"]).cast("string")))
    return detail.select(
        "listing_id", "brand", "page", F.array_join(F.col("images").cast("array<string>"), ",").alias("images"),
        F.when(F.col("sightings").isNotNull(), F.size("sightings")).alias("n_sightings"),
        F.md5(F.array_join(told, ",")).alias("sightings_md5"))


INCOMING = """
    incoming AS (SELECT user_id AS post_id, user_id % 3 AS chat_ref, event_id AS msg_key,
                        CASE WHEN event_type = 'signup' THEN 'text' ELSE 'image' END AS kind, event_type = 'error' AS missing
                 FROM events),
    stored AS (SELECT o_custkey % 3 AS chat_ref, o_orderkey AS msg_key FROM orders)"""


def _incoming(spark, folder):
    m = t.messages(spark, folder).select(F.col("sender").alias("post_id"), F.col("chat").alias("chat_ref"),
                                         F.col("key").alias("msg_key"), "kind", "missing")
    stored = t.load_table(spark, folder, "orders").select(
        (F.col("o_custkey") % 3).alias("chat_ref"), F.col("o_orderkey").alias("msg_key"))
    return m, stored


@query("known_message_filter", f"""
    WITH {INCOMING} SELECT post_id, msg_key FROM incoming i WHERE NOT EXISTS (
      SELECT 1 FROM stored s WHERE s.chat_ref = i.chat_ref AND s.msg_key = i.msg_key)""")
def known_message_filter(spark, folder):
    return op.known_message_filter(*_incoming(spark, folder)).select("post_id", "msg_key")


@query("ingest_status", f"""
    WITH {INCOMING},
    fresh AS (SELECT * FROM incoming i WHERE NOT EXISTS (
      SELECT 1 FROM stored s WHERE s.chat_ref = i.chat_ref AND s.msg_key = i.msg_key))
    SELECT p.post_id, count(f.msg_key) AS n_new, CASE WHEN coalesce(bool_or(f.kind = 'image' AND NOT f.missing), false)
           THEN 'accepted' ELSE 'duplicate' END AS status
    FROM (SELECT DISTINCT post_id FROM incoming) p LEFT JOIN fresh f ON f.post_id = p.post_id GROUP BY p.post_id""")
def ingest_status(spark, folder):
    return op.ingest_status(*_incoming(spark, folder), ["post_id"])


@query("unreferenced_blobs", f"""
    WITH {PHOTOS}, {BLOBS}
    SELECT b.sha256 FROM blobs b WHERE created_at < TIMESTAMP '1998-01-01' - INTERVAL 24 HOUR
      AND NOT EXISTS (SELECT 1 FROM photos i WHERE i.sha256 = b.sha256)
      AND NOT EXISTS (SELECT 1 FROM customer c WHERE sha256(CAST(c_custkey * 3 AS VARCHAR)) = b.sha256)""")
def unreferenced_blobs(spark, folder):
    wishlists = t.load_table(spark, folder, "customer").select(
        content_hash((F.col("c_custkey") * 3).cast("string")).alias("ref_image_sha"))
    return op.unreferenced_blobs(blobs(spark, folder), photos(spark, folder), wishlists,
                                 F.lit("1998-01-01 00:00:00").cast("timestamp")).select("sha256")


@query("media_referenced", f"""
    WITH {PHOTOS}, {BLOBS}, {POSTS}
    SELECT b.sha256 FROM blobs b WHERE EXISTS (
      SELECT 1 FROM photos i JOIN posts p ON p.post_id = i.post_id
      WHERE i.sha256 = b.sha256 AND (p.source = 'demo_seed' OR p.owner_session = 'u1'))""")
def media_referenced(spark, folder):
    return op.media_referenced(blobs(spark, folder), photos(spark, folder), posts(spark, folder), "u1").select("sha256")


@query("cross_source_orphans", f"""
    WITH {POSTS}, lst AS (SELECT listing_id, listing_id AS post_id FROM v_listing)
    SELECT s.listing_id, s.post_id, count(*) AS n FROM v_sighting s JOIN lst l ON l.listing_id = s.listing_id
    JOIN posts lp ON lp.post_id = l.post_id JOIN posts sp ON sp.post_id = s.post_id
    WHERE lp.source = 'chat_export' AND lp.status IN ('done', 'awaiting_vlm', 'failed') AND sp.source <> 'chat_export'
    GROUP BY ALL""", ("v_listing", "v_sighting"))
def cross_source_orphans(spark, folder):
    found = op.cross_source_orphans(t.sightings(spark, folder), stored_listings(spark, folder), posts(spark, folder),
                                    "chat_export")
    return found.groupBy("listing_id", "post_id").agg(F.count(F.lit(1)).alias("n"))


@query("reprocess_counts", f"""
    WITH {POSTS}, taken AS (SELECT post_id FROM posts WHERE source = 'chat_export'
                            AND status IN ('done', 'awaiting_vlm', 'failed'))
    SELECT (SELECT count(DISTINCT post_id) FROM taken) AS posts,
           (SELECT count(*) FROM v_listing l JOIN taken q ON q.post_id = l.listing_id) AS listings,
           (SELECT count(*) FROM v_sighting s JOIN taken q ON q.post_id = s.post_id) AS sightings""",
       ("v_listing", "v_sighting"))
def reprocess_counts(spark, folder):
    return op.reprocess_counts(posts(spark, folder), stored_listings(spark, folder), t.sightings(spark, folder),
                               "chat_export")


@query("reset_for_reprocess", f"""
    WITH {POSTS}, {PHOTOS}, taken AS (SELECT post_id FROM posts WHERE source = 'demo_upload'
                                      AND status IN ('done', 'awaiting_vlm', 'failed'))
    SELECT 'posts' AS name, count(*) AS n, count(*) FILTER (status = 'received' OR post_id IN (FROM taken)) AS marked
    FROM posts
    UNION ALL SELECT 'listings', count(*), 0 FROM v_listing WHERE listing_id NOT IN (FROM taken)
    UNION ALL SELECT 'sightings', count(*), 0 FROM v_sighting s JOIN posts p ON p.post_id = s.post_id
              WHERE p.source = 'demo_upload' AND s.post_id NOT IN (FROM taken)
    UNION ALL SELECT 'images', count(*), count(*) FILTER (post_id IN (FROM taken)) FROM photos
    UNION ALL SELECT 'refused', count(*) FILTER (n > 0), 0 FROM (
      SELECT count(*) AS n FROM v_sighting s JOIN posts p ON p.post_id = s.post_id
      WHERE p.source <> 'demo_upload' AND s.listing_id IN (FROM taken))""", ("v_listing", "v_sighting"))
def reset_for_reprocess(spark, folder):
    """Sizes of the four tables after a reset of the uploads, and how many rows were reset in place; and whether the
    reset refuses while sightings by other sources are there, as it does with the whole table of sightings."""
    p = posts(spark, folder)
    try:
        op.reset_for_reprocess(p, stored_listings(spark, folder), t.sightings(spark, folder), photos(spark, folder), "demo_upload")
        refused = 0
    except ValueError:
        refused = 1
    own = p.where(F.col("source") == "demo_upload").select("post_id")
    seen = t.sightings(spark, folder).join(own, "post_id", "left_semi")
    after = op.reset_for_reprocess(p, stored_listings(spark, folder), seen, photos(spark, folder), "demo_upload")
    marks = {"posts": F.col("status") == "received", "images": F.col("segment_idx").isNull()}
    counted = [df.agg(F.count(F.lit(1)).alias("n"), F.count_if(marks.get(n, F.lit(False))).alias("marked")).select(
        F.lit(n).alias("name"), "n", "marked") for n, df in after.items()]
    counted.append(p.agg(F.lit(refused).cast("long").alias("n")).select(
        F.lit("refused").alias("name"), "n", F.lit(0).cast("long").alias("marked")))
    return functools.reduce(lambda a, b: a.unionByName(b), counted)


@query("replace_by_source", """
    SELECT source, count(*) AS n, sum(price) AS total FROM (
      SELECT source, price FROM v_listing WHERE source <> 'demo_seed'
      UNION ALL SELECT source, price + 5 FROM v_listing WHERE source = 'demo_seed') GROUP BY source""", ("v_listing",))
def replace_by_source(spark, folder):
    """A refresh of the seed rows, written with dynamic partition overwrite and read back."""
    stored = t.listings(spark, folder, with_vector=False).select("listing_id", "price", "source")
    path = fresh_path(spark, "listings-by-source")
    stored.write.partitionBy("source").parquet(path)
    fresh = stored.withColumn("price", F.col("price") + 5)
    return op.replace_by_source(spark, path, fresh, "demo_seed").groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.sum("price").alias("total"))


@query("gap_listings", f"""
    WITH {POSTS}, {PHOTOS},
    rows AS (
      SELECT l.listing_id, EXISTS (SELECT 1 FROM photos i WHERE i.post_id = l.listing_id
                                   AND i.segment_idx = l.listing_id % 2 AND i.n_dets > 2) AS multi,
             array_to_string(list_filter([CASE WHEN l.size_eu IS NULL THEN 'size' END,
                                          CASE WHEN l.price IS NULL THEN 'price' END], lambda x: x IS NOT NULL), ',')
             AS missing
      FROM v_listing l JOIN posts p ON p.post_id = l.listing_id
      WHERE p.status = 'done' AND p.vlm_policy = 'never' AND l.listing_id % 3 <> 0)
    SELECT listing_id, CASE WHEN multi THEN 'multi_item' ELSE 'missing:' || missing END AS reason, missing
    FROM rows WHERE multi OR missing <> ''""", ("v_listing",))
def gap_listings(spark, folder):
    gaps = op.gap_listings(stored_listings(spark, folder), posts(spark, folder), photos(spark, folder), "ollama")
    return gaps.select("listing_id", "reason", F.array_join("missing", ",").alias("missing"))


@query("ttl_purge", f"""
    WITH {POSTS}, {PHOTOS}, gone AS (SELECT post_id FROM posts WHERE source = 'demo_upload'
                                     AND created_at < TIMESTAMP '1998-01-01' - INTERVAL 24 HOUR),
    away AS (SELECT listing_id FROM v_listing WHERE listing_id IN (FROM gone)),
    wish AS (SELECT wishlist_id, 'ref' || wishlist_id % 50 AS ref FROM v_wishlist WHERE owner = 'local' OR wishlist_id % 2 = 0),
    kept AS (SELECT * FROM photos WHERE post_id NOT IN (FROM gone)),
    blobs AS (SELECT DISTINCT sha256, image_id % 3 = 0 AS fresh FROM photos WHERE image_id < 5000
              UNION ALL SELECT 'ref' || i, false FROM range(50) r(i))
    SELECT 'posts' AS name, count(*) AS n FROM posts WHERE post_id NOT IN (FROM gone)
    UNION ALL SELECT 'images', count(*) FROM kept
    UNION ALL SELECT 'listings', count(*) FROM v_listing WHERE listing_id NOT IN (FROM away)
    UNION ALL SELECT 'sightings', count(*) FROM v_sighting WHERE post_id NOT IN (FROM gone) AND listing_id NOT IN (FROM away)
    UNION ALL SELECT 'calls', count(*) FROM v_calls WHERE post_id NOT IN (FROM gone)
    UNION ALL SELECT 'matches', count(*) FROM v_listing l, range(4) r(i)
              WHERE l.listing_id NOT IN (FROM away) AND (l.listing_id * 4 + i) % 200 IN (SELECT wishlist_id FROM wish)
    UNION ALL SELECT 'blobs', count(*) FROM blobs
              WHERE fresh OR sha256 IN (SELECT sha256 FROM kept) OR sha256 IN (SELECT ref FROM wish)
    UNION ALL SELECT 'wishlists', count(*) FROM wish""", ("v_listing", "v_sighting", "v_wishlist", "v_calls"))
def ttl_purge(spark, folder):
    at = F.lit("1998-01-01 00:00:00").cast("timestamp")
    age = lambda fresh: at - F.when(fresh, F.expr("interval 1 hour")).otherwise(F.expr("interval 3 days"))
    n = F.col("wishlist_id")
    wishlists = t.wishlists(spark, folder, with_vector=False).withColumn("created_at", age(n % 2 == 0)).withColumn(
        "ref_image_sha", F.concat(F.lit("ref"), (n % 50).cast("string")))
    stored, shots = stored_listings(spark, folder), photos(spark, folder)
    matches = stored.select("listing_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i")).select(
        "listing_id", ((F.col("listing_id") * 4 + F.col("i")) % 200).alias("wishlist_id")).join(
        wishlists.select("wishlist_id"), "wishlist_id", "left_semi")
    contents = shots.where("image_id < 5000").select("sha256", age(F.col("image_id") % 3 == 0).alias("created_at")).distinct()
    refs = spark.range(50).select(F.concat(F.lit("ref"), F.col("id").cast("string")).alias("sha256"),
                                  age(F.lit(False)).alias("created_at"))
    kept = op.ttl_purge({"posts": posts(spark, folder), "wishlists": wishlists, "images": shots, "listings": stored,
                         "sightings": t.sightings(spark, folder), "calls": t.calls(spark, folder), "matches": matches,
                         "blobs": contents.unionByName(refs)}, at)
    counted = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("name"), "n") for n, df in kept.items()]
    return functools.reduce(lambda a, b: a.unionByName(b), counted)


@query("stale_album_filter", """
    SELECT user_id AS sender, CASE WHEN max(ts) < TIMESTAMP '2024-02-06 12:00:00' - INTERVAL 7 DAY THEN 'stale' END
           AS reject_reason FROM events GROUP BY user_id""")
def stale_album_filter(spark, folder):
    albums = t.messages(spark, folder).groupBy("sender").agg(F.max("ts").alias("last_arrival"))
    judged = op.stale_albums(albums, F.col("last_arrival"), F.lit("2024-02-06 12:00:00").cast("timestamp"))
    return judged.select("sender", "reject_reason")


UPSERT_ORDER = ("seen_at", "price", "suppkey")


@query("upsert_sink", """
    WITH newest AS (
      SELECT listing_id, price FROM (SELECT *, row_number() OVER (PARTITION BY listing_id
        ORDER BY seen_at DESC, price DESC, suppkey DESC) AS rn FROM v_sighting) WHERE rn = 1)
    SELECT listing_id, price FROM newest
    UNION ALL SELECT listing_id, CAST(price AS DOUBLE) FROM v_listing
              WHERE listing_id NOT IN (SELECT listing_id FROM newest)""", ("v_listing", "v_sighting"))
def upsert_sink(spark, folder):
    stored = t.listings(spark, folder, with_vector=False).select("listing_id", F.col("price").cast("double"))
    stored = stored.withColumns({"seen_at": F.lit(None).cast("timestamp"), "suppkey": F.lit(None).cast("long")})
    table = BucketTable.new(spark, "listings", stored.schema, ["listing_id"])
    table.append(stored)
    new = t.sightings(spark, folder).select("listing_id", "price", "seen_at", "suppkey")
    table.upsert(new, ["listing_id"], [F.col(c) for c in UPSERT_ORDER])
    return table.read().select("listing_id", "price")


@query("insert_ignore_sink", """
    SELECT post_id, segment_idx, min(listing_id) AS listing_id, count(*) AS n FROM (
      SELECT post_id, segment_idx, listing_id, row_number() OVER (PARTITION BY post_id, segment_idx
               ORDER BY seen_at, listing_id, suppkey) AS rn FROM v_sighting WHERE segment_idx <= 2
      UNION ALL
      SELECT post_id, segment_idx, listing_id, row_number() OVER (PARTITION BY post_id, segment_idx
               ORDER BY seen_at, listing_id, suppkey) FROM v_sighting WHERE segment_idx > 2)
    WHERE rn = 1 GROUP BY post_id, segment_idx""", ("v_sighting",))
def insert_ignore_sink(spark, folder):
    """First lines stored, then all lines offered: only new (post, segment) pairs are appended."""
    s = t.sightings(spark, folder)
    order = [F.col(c) for c in ("seen_at", "listing_id", "suppkey")]
    key = ["post_id", "segment_idx"]
    path = sinks.write_snapshot(t.first_rows(s.where("segment_idx <= 2"), key, order, 1).drop("rn"), "sightings")
    sinks.insert_ignore_sink(spark, path, s, key, order)
    return spark.read.parquet(path).groupBy(*key).agg(
        F.min("listing_id").alias("listing_id"), F.count(F.lit(1)).alias("n"))


@query("media_sink", """
    SELECT substring(sha, 1, 2) AS prefix, count(*) AS n, min(sha) AS first_sha
    FROM (SELECT DISTINCT sha256(text) AS sha FROM v_text) GROUP BY 1""", ("v_text",))
def media_sink(spark, folder):
    path = sinks.media_sink(t.texts(spark, folder), "text", "media")
    return spark.read.parquet(path).groupBy(F.col("prefix").cast("string").alias("prefix")).agg(
        F.count(F.lit(1)).alias("n"), F.min("sha256").alias("first_sha"))


@query("listing_json", """
    SELECT listing_id, json_extract_string(doc, '$.brand') AS brand, CAST(json_extract(doc, '$.size_eu') AS DOUBLE) AS size_eu,
           json_extract_string(doc, '$.sources.size') AS size_source,
           json_extract_string(doc, '$.last_seen_at') AS last_seen_at, CAST(json_extract(doc, '$.score') AS DOUBLE) AS score
    FROM (SELECT listing_id, to_json({brand: brand, size_eu: CAST(size_eu AS DOUBLE), sources: {size: size_source},
                 last_seen_at: strftime(last_seen, '%Y-%m-%dT%H:%M:%SZ'), score: round((listing_id % 1000) / 1024.0, 4)})
                 AS doc FROM v_listing)""", ("v_listing",))
def listing_json(spark, folder):
    rows = stored_listings(spark, folder).withColumns({
        "sources": F.create_map(F.lit("size"), F.col("size_source"), F.lit("brand"), F.col("brand_source")),
        "cover_sha": F.encode(F.col("listing_id").cast("string"), "UTF-8"),
        "score": F.col("listing_id") % 1000 / 1024})
    docs = rows.select("listing_id", sinks.listing_json(rows).alias("doc"))
    get = lambda p: F.get_json_object("doc", p)
    return docs.select("listing_id", get("$.brand").alias("brand"), get("$.size_eu").cast("double").alias("size_eu"),
                       get("$.sources.size").alias("size_source"), get("$.last_seen_at").alias("last_seen_at"),
                       get("$.score").cast("double").alias("score"))


@query("read_manifest", """
    SELECT 'item-' || (p_partkey % 900) AS slug, p_name AS caption, p_brand AS brand,
           CASE WHEN count(*) OVER (PARTITION BY p_partkey % 900) > 1 THEN 'duplicate_slug' ELSE '' END AS problems
    FROM part""")
def read_manifest(spark, folder):
    """Parts as manifests of posts, written as JSON documents and read back under the fixed schema."""
    n = F.col("p_partkey")
    post = F.struct(
        F.concat(F.lit("item-"), (n % 900).cast("string")).alias("slug"), F.lit("Demo Seller 1").alias("seller"),
        F.col("p_name").alias("caption"), F.lit(1.5).alias("days_ago"), F.array(F.lit("a.jpg")).alias("images"),
        F.struct(F.col("p_brand").alias("brand"), F.col("p_size").cast("double").alias("size_eu")).alias("attrs"))
    docs = t.load_table(spark, folder, "part").select(
        F.to_json(F.struct(F.lit(1).alias("version"), F.array(post).alias("posts"))).alias("value"))
    path = fresh_path(spark, "manifest")
    docs.write.text(path)
    rows = files.read_manifest_lines(spark, path)
    return rows.select("slug", "caption", F.col("attrs.brand").alias("brand"),
                       F.array_join("problems", ",").alias("problems"))


@query("read_attribution", """
    SELECT 'f' || p_partkey AS file, md5(p_name) AS sha256, 'CC-BY-4.0' AS license, p_name AS notes FROM part""")
def read_attribution(spark, folder):
    n = F.col("p_partkey")
    rows = t.load_table(spark, folder, "part").select(
        F.concat(F.lit("f"), n.cast("string")).alias("file"), F.md5("p_name").alias("sha256"),
        F.lit("https://x").alias("source_url"), F.lit("someone").alias("author"), F.lit("CC-BY-4.0").alias("license"),
        F.lit("https://y").alias("license_url"), F.col("p_name").alias("notes"))
    path = fresh_path(spark, "attribution")
    rows.write.option("header", True).csv(path)
    return files.read_attribution(spark, path).select("file", "sha256", "license", "notes")
