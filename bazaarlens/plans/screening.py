"""Screening queries: message, post and listing rules, scans and notification text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarlens.functions import captions
from bazaarlens.functions import text as tx
from bazaarlens.operators import screening as op
from bazaarlens.plans.registry import query
from bazaarlens.sources import tables as t

APP = "Listings"
NOW_S = 1706745600  # 2024-02-01, the day after the event stream ends
BACKLOG_S = 20 * 86400

RAW_SQL = """
    SELECT event_id, CAST(user_id % 3 AS VARCHAR) AS remote, user_id % 11 = 0 AS from_me, event_id % 29 <> 0 AS has_body,
           CASE WHEN event_id % 17 = 0 THEN 1 END AS stub_type,
           CASE event_id % 13 WHEN 0 THEN 'history' WHEN 1 THEN 'append' ELSE 'notify' END AS delivery,
           CAST(floor(epoch(ts)) AS BIGINT) AS ts_s,
           CASE WHEN event_id % 19 <> 0 THEN 'p' || user_id END AS participant, event_id % 23 = 0 AS view_once,
           CASE event_type WHEN 'view' THEN 'image' WHEN 'click' THEN 'document' WHEN 'purchase' THEN 'text'
                WHEN 'signup' THEN 'protocol' ELSE 'sticker' END AS content,
           CASE WHEN event_id % 2 = 0 THEN 'image/png' ELSE 'application/pdf' END AS mimetype,
           CASE WHEN event_id % 5 = 0 THEN '' ELSE props END AS text
    FROM events"""
VERDICT_SQL = f"""
    SELECT event_id, CASE
        WHEN remote <> '1' THEN 'other_chat' WHEN from_me THEN 'from_me'
        WHEN NOT has_body OR stub_type IS NOT NULL THEN 'stub'
        WHEN delivery NOT IN ('notify', 'append') THEN 'unknown_type'
        WHEN {NOW_S} - ts_s > {BACKLOG_S} THEN 'too_old' WHEN participant IS NULL THEN 'no_sender'
        WHEN view_once THEN 'view_once' WHEN content = 'protocol' THEN 'protocol'
        WHEN content = 'image' OR (content = 'document' AND mimetype = 'image/png') THEN 'image'
        WHEN content = 'text' AND length(text) > 0 THEN 'text'
        ELSE 'unsupported:' || content END AS verdict
    FROM ({RAW_SQL})"""


def _raw(spark, folder) -> DataFrame:
    e = t.load_table(spark, folder, "events")
    eid, uid = F.col("event_id"), F.col("user_id")
    kind = F.col("event_type")
    return e.select(
        "event_id", (uid % 3).cast("string").alias("remote"), (uid % 11 == 0).alias("from_me"),
        (eid % 29 != 0).alias("has_body"), F.when(eid % 17 == 0, 1).alias("stub_type"),
        F.when(eid % 13 == 0, "history").when(eid % 13 == 1, "append").otherwise("notify").alias("delivery"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts_s"),
        F.when(eid % 19 != 0, F.concat(F.lit("p"), uid.cast("string"))).alias("participant"),
        (eid % 23 == 0).alias("view_once"),
        F.when(kind == "view", "image").when(kind == "click", "document").when(kind == "purchase", "text")
        .when(kind == "signup", "protocol").otherwise("sticker").alias("content"),
        F.when(eid % 2 == 0, "image/png").otherwise("application/pdf").alias("mimetype"),
        F.when(eid % 5 == 0, "").otherwise(F.col("props")).alias("text"))


def _verdicts(spark, folder) -> DataFrame:
    return op.classify_messages(_raw(spark, folder), group="1", now_s=F.lit(NOW_S), max_backlog_s=BACKLOG_S)


@query("classify_messages", VERDICT_SQL)
def classify_messages(spark, folder):
    return _verdicts(spark, folder).select("event_id", "verdict")


@query("drop_reason_counts", f"SELECT verdict AS reason, count(*) AS n FROM ({VERDICT_SQL}) GROUP BY verdict")
def drop_reason_counts(spark, folder):
    return op.reason_counts(_verdicts(spark, folder))


@query("drop_too_old", f"""
    SELECT event_type, count(*) AS n, min(event_id) AS first_id FROM events
    WHERE {NOW_S} - CAST(floor(epoch(ts)) AS BIGINT) <= {BACKLOG_S} GROUP BY event_type""")
def drop_too_old(spark, folder):
    e = t.load_table(spark, folder, "events")
    kept = op.drop_too_old(e, F.unix_seconds(F.col("ts").cast("timestamp")), F.lit(NOW_S), BACKLOG_S)
    return kept.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))


@query("validate_messages", """
    SELECT key, array_to_string(list_filter([
             CASE WHEN key = '' THEN 'bad_key' END, CASE WHEN kind NOT IN ('image', 'text') THEN 'bad_kind' END,
             CASE WHEN length(caption) > 4096 THEN 'caption_too_long' END,
             CASE WHEN NOT (sent_at >= TIMESTAMP '2009-01-01' AND sent_at <= TIMESTAMP '2024-01-26 00:00:00')
                  THEN 'sent_at_out_of_range' END,
             CASE WHEN kind = 'text' AND (file_field IS NOT NULL OR missing) THEN 'text_with_media' END,
             CASE WHEN kind = 'image' AND (file_field IS NOT NULL) = missing THEN 'image_needs_file_xor_missing' END
           ], lambda x: x IS NOT NULL), ',') AS problems
    FROM (SELECT 'k' || key AS key, kind, missing, ts AS sent_at, event_type AS caption,
                 CASE WHEN key % 7 <> 0 THEN 'f' || key END AS file_field FROM v_messages)""", ("v_messages",))
def validate_messages(spark, folder):
    m = t.messages(spark, folder).select(
        F.concat(F.lit("k"), F.col("key").cast("string")).alias("key"), "kind", F.col("ts").alias("sent_at"),
        F.col("event_type").alias("caption"), F.col("missing").alias("missing_media"),
        F.when(F.col("key") % 7 != 0, F.concat(F.lit("f"), F.col("key").cast("string"))).alias("file_field"))
    checked = op.validate_messages(m, F.lit("2024-01-25 00:00:00").cast("timestamp"))
    return checked.select("key", F.array_join("problems", ",").alias("problems"))


@query("validate_posts", """
    SELECT post_id, n_messages,
           sha256('whatsapp' || chr(10) || chat || chr(10) || keys) AS idem_key,
           array_to_string(list_filter([
             CASE WHEN n_keys < n_messages THEN 'duplicate_message_keys' END,
             CASE WHEN n_file_fields < n_files THEN 'duplicate_file_fields' END,
             CASE WHEN NOT has_image THEN 'no_image_message' END], lambda x: x IS NOT NULL), ',') AS problems
    FROM (SELECT post_id, count(*) AS n_messages, count(DISTINCT key) AS n_keys, min(chat) AS chat,
                 count(file_field) AS n_files, count(DISTINCT file_field) AS n_file_fields,
                 bool_or(kind = 'image' AND NOT missing) AS has_image,
                 string_agg(DISTINCT key, chr(10) ORDER BY key) AS keys
          FROM (SELECT post_id, 'm' || (message_id // 2) AS key, kind, missing, 'c' || (post_id % 3) AS chat,
                       CASE WHEN kind = 'image' AND NOT missing THEN 'f' || (seq % 4) END AS file_field
                FROM v_post_messages) GROUP BY post_id)""", ("v_post_messages",))
def validate_posts(spark, folder):
    m = t.post_messages(spark, folder).select(
        "post_id", F.concat(F.lit("m"), F.floor(F.col("message_id") / 2).cast("string")).alias("key"), "kind",
        "missing", F.lit("whatsapp").alias("source"),
        F.concat(F.lit("c"), (F.col("post_id") % 3).cast("string")).alias("chat"),
        F.when((F.col("kind") == "image") & ~F.col("missing"),
               F.concat(F.lit("f"), (F.col("seq") % 4).cast("string"))).alias("file_field"))
    return op.validate_posts(m, ["post_id"]).select(
        "post_id", "n_messages", "idem_key", F.array_join("problems", ",").alias("problems"))


@query("media_rules", """
    SELECT id, CASE WHEN octet_length(encode(text)) > 8000 THEN 'too_large'
                    WHEN NOT starts_with(text, '<!DOCTYPE') THEN 'not_markup' ELSE 'bad_type' END AS verdict
    FROM v_text""", ("v_text",))
def media_rules(spark, folder):
    """Texts are no photos, so the type test refuses each of them that is not already too large."""
    texts = t.texts(spark, folder)
    content = F.encode(F.col("text"), "UTF-8")
    verdict = op.media_verdict(content, F.octet_length(content), max_bytes=8000)
    refined = F.when((verdict == "bad_type") & ~F.col("text").startswith("<!DOCTYPE"), "not_markup").otherwise(verdict)
    return texts.select("id", refined.alias("verdict"))


@query("visible_to", """
    SELECT listing_id, source, owner_session FROM v_listing WHERE source = 'demo_seed' OR owner_session = 'u1'
    """, ("v_listing",))
def visible_to(spark, folder):
    rows = t.listings(spark, folder, with_vector=False)
    return op.visible_to(rows, "u1").select("listing_id", "source", "owner_session")


@query("listing_filters", """
    SELECT listing_id, brand, CAST(size_eu AS DOUBLE) AS size_eu, price FROM v_listing
    WHERE (size_eu IS NULL OR size_eu BETWEEN 20 - (CASE WHEN size_source = 'vlm' THEN 1 ELSE 0 END)
                                          AND 30 + (CASE WHEN size_source = 'vlm' THEN 1 ELSE 0 END))
      AND (price IS NULL OR price <= 950)""", ("v_listing",))
def listing_filters(spark, folder):
    rows = t.listings(spark, folder, with_vector=False)
    kept = op.listing_filters(rows, size_min=20, size_max=30, max_price=950)
    return kept.select("listing_id", "brand", F.col("size_eu").cast("double").alias("size_eu"), "price")


@query("brand_family", """
    SELECT listing_id, CASE lower(label) WHEN 'jordan' THEN 'nike' WHEN 'yeezy' THEN 'adidas' ELSE lower(label) END
           AS family
    FROM (SELECT listing_id, CASE listing_id % 4 WHEN 0 THEN 'Jordan' WHEN 1 THEN 'Yeezy' ELSE brand END AS label
          FROM v_listing)""", ("v_listing",))
def brand_family(spark, folder):
    rows = t.listings(spark, folder, with_vector=False)
    label = F.when(F.col("listing_id") % 4 == 0, "Jordan").when(F.col("listing_id") % 4 == 1, "Yeezy").otherwise(
        F.col("brand"))
    return rows.select("listing_id", captions.brand_family(label).alias("family"))


@query("group_date_range", """
    SELECT sender, chat, epoch_us(first_ts) AS first_us, n
    FROM (SELECT sender, chat, CAST(ts AS DATE) AS day, min(ts) AS first_ts, count(*) AS n FROM v_messages
          GROUP BY ALL)
    WHERE first_ts >= TIMESTAMP '2024-01-05' AND first_ts < TIMESTAMP '2024-01-20'
    ORDER BY first_ts, sender LIMIT 500""", ("v_messages",))
def group_date_range(spark, folder):
    """The limit is the operator's own: the first groups of a date range."""
    days = t.messages(spark, folder).groupBy("sender", "chat", F.to_date("ts").alias("day")).agg(
        F.min("ts").alias("first_ts"), F.count(F.lit(1)).alias("n"))
    picked = op.group_date_range(
        days, F.col("first_ts"), since=F.lit("2024-01-05").cast("timestamp"),
        before=F.lit("2024-01-20").cast("timestamp"), limit=500, order=[F.col("first_ts"), F.col("sender")])
    return picked.select("sender", "chat", F.unix_micros("first_ts").alias("first_us"), "n")


@query("needs_enrichment", """
    SELECT listing_id, reason, reason = 'multi_item' OR starts_with(reason, 'missing:') AS needed,
           CASE WHEN reason IN ('policy', 'repost', 'no_shoe') THEN '' ELSE missing END AS missing
    FROM (SELECT listing_id, missing, CASE
            WHEN listing_id % 9 = 0 THEN 'policy' WHEN repost_count = 3 THEN 'repost' WHEN listing_id % 8 = 5 THEN 'no_shoe'
            WHEN listing_id % 10 = 7 THEN 'multi_item' WHEN missing = '' THEN 'local_sufficient'
            ELSE 'missing:' || missing END AS reason
          FROM (SELECT listing_id, repost_count, array_to_string(list_filter([
                  CASE WHEN listing_id % 6 = 0 THEN 'brand' END, CASE WHEN size_eu IS NULL THEN 'size' END,
                  CASE WHEN price IS NULL AND listing_id % 2 = 0 THEN 'price' END], lambda x: x IS NOT NULL), ',') AS missing
                FROM v_listing))""", ("v_listing",))
def needs_enrichment(spark, folder):
    lid = F.col("listing_id")
    rows = t.listings(spark, folder, with_vector=False).select(
        "listing_id", F.when(lid % 6 != 0, F.col("brand")).alias("brand"),
        F.col("size_eu").cast("string").alias("size_label"), "price", (lid % 2 == 1).alias("price_on_request"),
        (F.col("repost_count") == 3).alias("repost"), (lid % 8 == 5).alias("no_shoe"),
        (lid % 10 == 7).alias("multi_item"))
    decided = op.needs_enrichment(rows, policy=F.when(lid % 9 == 0, "never").otherwise("auto"),
                                  provider=F.lit("ollama"))
    return decided.select("listing_id", "needed", "reason", F.array_join("missing", ",").alias("missing"))


@query("pii_scan", r"""
    SELECT id, finding FROM (
      SELECT id, unnest([CASE WHEN regexp_matches(text, '\+?\d[\d\s\-()]{7,}\d') THEN 'phone' END,
                         CASE WHEN regexp_matches(text, '@s\.whatsapp\.net') THEN 'messenger_id' END,
                         CASE WHEN regexp_matches(text, 'wa\.me/') THEN 'chat_link' END,
                         CASE WHEN regexp_matches(text, '(?i)https?://|www\.') THEN 'url' END]) AS finding
      FROM v_text) WHERE finding IS NOT NULL""", ("v_text",))
def pii_scan(spark, folder):
    return op.pii_scan(t.texts(spark, folder), "id", "text")


@query("secret_scan")
def secret_scan(spark, folder):
    """Offsets come from patterns with lookaround, which the SQL engine lacks: checked by unit tests."""
    return op.secret_scan(t.texts(spark, folder), "id", "text")


@query("mask_digits", r"""
    SELECT id, md5(array_to_string(list_transform(list_zip(regexp_split_to_array(text, '\d{7,}'),
                                                 regexp_extract_all(text, '\d{7,}')),
             lambda x: coalesce(x[1], '') || coalesce(substring(x[2], 1, 2) || repeat('*', length(x[2]) - 2), '')), ''))
           AS masked_md5
    FROM v_text""", ("v_text",))
def mask_digits(spark, folder):
    return t.texts(spark, folder).select("id", F.md5(tx.mask_digits(F.col("text"))).alias("masked_md5"))


@query("strip_controls", r"""
    SELECT id, md5(regexp_replace(text, '[\x00-\x09\x0b-\x1f\x7f]', '', 'g')) AS kept_md5,
           md5(substring(regexp_replace(text, '[\x00-\x1f\x7f]', ' ', 'g'), 1, 200)) AS body_md5
    FROM v_text""", ("v_text",))
def strip_controls(spark, folder):
    return t.texts(spark, folder).select(
        "id", F.md5(tx.strip_controls(F.col("text"))).alias("kept_md5"),
        F.md5(tx.notification_text(F.col("text"), 200)).alias("body_md5"))


@query("describe_match", f"""
    SELECT listing_id, substring('{APP}: ' || brand || ' ' || model, 1, 80) AS title,
           concat_ws(' · ', CASE WHEN size_eu IS NULL THEN 'size unknown'
                                 ELSE 'Size EU ' || CAST(size_eu AS INTEGER)
                                      || CASE WHEN size_source = 'vlm' THEN ' (read by AI)' ELSE '' END END,
                     CASE WHEN price IS NOT NULL THEN
                       (CASE WHEN coalesce(currency, '') IN ('PKR', '') THEN 'Rs' ELSE currency END)
                       || ' ' || format('{{:,}}', price * 7) END,
                     CASE WHEN repost_count > 0 THEN 'posted ' || (repost_count + 1) || '×' END) AS body
    FROM v_listing""", ("v_listing",))
def describe_match(spark, folder):
    rows = t.listings(spark, folder, with_vector=False).withColumn("price", F.col("price") * 7).withColumn(
        "size_label", captions.size_label(F.lit("EU"), F.col("size_eu")))
    return op.describe_match(rows, app_name=APP).select("listing_id", "title", "body")
