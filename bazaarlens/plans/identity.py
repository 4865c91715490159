"""Identity queries: content keys, pseudonyms, hashes."""

from __future__ import annotations

from pyspark.sql import functions as F

from bazaarlens.functions import ids
from bazaarlens.operators.chat_export import occurrence_keys
from bazaarlens.plans.registry import query
from bazaarlens.sources import tables as t

HMAC_KEY = "local-test-key"


@query("idempotency_key", """
    SELECT post_id, sha256('chat_export' || chr(10) || 'c' || (post_id % 3) || chr(10)
                           || string_agg(DISTINCT key, chr(10) ORDER BY key)) AS idem_key
    FROM (SELECT post_id, 'm' || message_id AS key FROM v_post_messages) GROUP BY post_id""", ("v_post_messages",))
def idempotency_key(spark, folder):
    m = t.post_messages(spark, folder).select(
        "post_id", F.concat(F.lit("m"), F.col("message_id").cast("string")).alias("key"))
    keyed = m.groupBy("post_id").agg(F.collect_set("key").alias("_keys"))  # a post's key is over all of its keys
    chat = F.concat(F.lit("c"), (F.col("post_id") % 3).cast("string"))
    key = ids.idempotency_key(F.lit("chat_export"), chat, F.col("_keys"))
    return keyed.select("post_id", key.alias("idem_key"))


def _pad(byte: int) -> str:
    return bytes(b ^ byte for b in HMAC_KEY.encode().ljust(ids.SHA_BLOCK, b"\0")).hex()


@query("pseudonymise", f"""
    SELECT sender, substring(sha256(unhex('{_pad(0x5C)}') || unhex(sha256(unhex('{_pad(0x36)}')
             || encode('s:' || regexp_replace(lower(jid), ':\\d+@', '@', 'g'))))), 1, 32) AS sender_ref
    FROM (SELECT DISTINCT sender, 'User' || sender || ':' || (sender % 9) || '@Net' AS jid FROM v_messages)
    """, ("v_messages",))
def pseudonymise(spark, folder):
    senders = t.messages(spark, folder).select("sender").distinct()
    who = F.col("sender").cast("string")
    jid = F.concat(F.lit("User"), who, F.lit(":"), (F.col("sender") % 9).cast("string"), F.lit("@Net"))
    return senders.select("sender", ids.sender_ref(jid, HMAC_KEY).alias("sender_ref"))


@query("occurrence_key", """
    SELECT event_id, occurrence, 'exp:' || substring(sha256('chat' || chr(31) || day || chr(31) || user_id || chr(31)
           || event_type || chr(31) || occurrence), 1, 32) AS key
    FROM (SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, user_id, event_type,
                 row_number() OVER (PARTITION BY CAST(ts AS DATE), user_id, event_type ORDER BY event_id) - 1
                 AS occurrence FROM events)""")
def occurrence_key(spark, folder):
    e = t.load_table(spark, folder, "events").select(
        "event_id", F.date_format("ts", "yyyy-MM-dd").alias("header"), F.col("user_id").cast("string").alias("sender"),
        F.col("event_type").alias("ident"))
    keyed = occurrence_keys(e, F.lit("chat"), F.col("event_id"))
    return keyed.select("event_id", "occurrence", "key")


@query("seen_key", """
    SELECT event_id, substring(sha256((user_id % 3) || '@g.us|' || event_id || '|'
           || CASE WHEN user_id % 7 = 0 THEN '' ELSE 'p' || user_id END), 1, 24) AS seen_key FROM events""")
def seen_key(spark, folder):
    e = t.load_table(spark, folder, "events")
    remote = F.concat((F.col("user_id") % 3).cast("string"), F.lit("@g.us"))
    participant = F.when(F.col("user_id") % 7 != 0, F.concat(F.lit("p"), F.col("user_id").cast("string")))
    return e.select("event_id", ids.seen_key(remote, F.col("event_id").cast("string"), participant).alias("seen_key"))


@query("log_mask", """
    SELECT event_id, CASE WHEN user_id % 7 = 0 THEN 'u:none'
           ELSE 'u:' || substring(sha256('salt' || 'p' || user_id), 1, 8) END AS masked FROM events""")
def log_mask(spark, folder):
    e = t.load_table(spark, folder, "events")
    who = F.when(F.col("user_id") % 7 != 0, F.concat(F.lit("p"), F.col("user_id").cast("string")))
    return e.select("event_id", ids.log_mask(who, "salt").alias("masked"))


@query("content_hash", """
    SELECT sha, count(*) AS n, min(id) AS first_id FROM (SELECT id, sha256(text) AS sha FROM v_text) GROUP BY sha
    """, ("v_text",))
def content_hash(spark, folder):
    """Exact duplicates by content address."""
    hashed = t.texts(spark, folder).select("id", ids.content_hash(F.col("text")).alias("sha"))
    return hashed.groupBy("sha").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


@query("hamming64", """
    SELECT post_id, bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) AS distance
    FROM v_doc_image a JOIN (SELECT listing_id AS anchor, max(hi) AS hi, max(lo) AS lo FROM v_doc_image
                             WHERE post_id = 0 GROUP BY 1) b ON true""", ("v_doc_image",))
def hamming64(spark, folder):
    """Distance of every text's fingerprint to that of the first text."""
    images = t.doc_images(spark, folder)
    anchor = images.where(F.col("post_id") == 0).agg(F.max("phash").alias("anchor"))  # one row
    return images.join(F.broadcast(anchor)).select(
        "post_id", ids.hamming64(F.col("phash"), F.col("anchor")).cast("long").alias("distance"))


@query("stable_order_hash", """
    SELECT listing_id, md5(listing_id || ':' || seller) AS h FROM v_listing""", ("v_listing",))
def stable_order_hash(spark, folder):
    """The hash that orders every seller's listings in a repeatable shuffle."""
    rows = t.listings(spark, folder, with_vector=False)
    return rows.select("listing_id", ids.stable_order_hash(F.col("listing_id"), F.col("seller")).alias("h"))
