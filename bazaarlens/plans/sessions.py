"""Session queries: islands, albums, message caps and sliding quotas over the message stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from bazaarlens.operators import chunked
from bazaarlens.operators import sessions as op
from bazaarlens.plans.registry import query
from bazaarlens.sources import tables as t

# Test events are hours apart, so the rules are wider than the defaults.
RULES = op.AlbumRules(idle_s=6 * 3600, span_s=24 * 3600, max_images=5, max_bytes=20_000_000)
ORDER = ("ts_us", "key")

ALBUM_STEPS = f"""
    WITH RECURSIVE m AS (
      SELECT *, epoch_us(ts) AS us, row_number() OVER (PARTITION BY sender ORDER BY ts, key) AS rn FROM v_messages),
    step AS (
      SELECT sender, rn, key, kind, missing, us, us AS first_us, us AS last_us,
             CASE WHEN kind = 'image' THEN 1 ELSE 0 END AS images, CASE WHEN kind = 'image' THEN bytes ELSE 0 END AS used,
             key AS album_key
      FROM m WHERE rn = 1
      UNION ALL
      SELECT m.sender, m.rn, m.key, m.kind, m.missing, m.us, CASE WHEN f.fits THEN s.first_us ELSE m.us END,
             CASE WHEN f.fits THEN greatest(s.last_us, m.us) ELSE m.us END,
             (CASE WHEN f.fits THEN s.images ELSE 0 END) + (CASE WHEN m.kind = 'image' THEN 1 ELSE 0 END),
             (CASE WHEN f.fits THEN s.used ELSE 0 END) + (CASE WHEN m.kind = 'image' THEN m.bytes ELSE 0 END),
             CASE WHEN f.fits THEN s.album_key ELSE m.key END
      FROM step s JOIN m ON m.sender = s.sender AND m.rn = s.rn + 1,
           LATERAL (SELECT m.us - s.last_us <= {RULES.idle_s} * 1000000::BIGINT
                       AND m.us - s.first_us <= {RULES.span_s} * 1000000::BIGINT
                       AND (m.kind <> 'image' OR (s.images < {RULES.max_images}
                            AND s.used + m.bytes <= {RULES.max_bytes})) AS fits) f),
    albums AS (
      SELECT album_key, count(*) AS n_messages, sum(CASE WHEN kind = 'image' THEN 1 ELSE 0 END) AS n_images,
             bool_or(kind = 'image' AND NOT missing) AS usable FROM step GROUP BY album_key)
"""


def timed_messages(spark, folder):
    return t.messages(spark, folder).withColumn("ts_us", F.unix_micros("ts")).withColumn(
        "ts_s", F.col("ts_us") / F.lit(1e6))


def sender_line():
    return op.sender_line([F.col(c) for c in ORDER], chunked.by_days(F.col("ts"), 30))


@query("album_islands", f"""
    SELECT key, sum(cut) OVER (PARTITION BY sender ORDER BY ts, key ROWS UNBOUNDED PRECEDING) AS island
    FROM (SELECT key, sender, ts, CASE WHEN lag(ts) OVER (PARTITION BY sender ORDER BY ts, key) IS NULL
               OR epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY sender ORDER BY ts, key))
                  > {RULES.idle_s} * 1000000::BIGINT
               THEN 1 ELSE 0 END AS cut FROM v_messages)""", ("v_messages",))
def album_islands(spark, folder):
    cut = op.album_islands(timed_messages(spark, folder), sender_line(), RULES.idle_s)
    return cut.select("key", "island")


@query("group_albums", ALBUM_STEPS + """
    SELECT s.key, s.album_key FROM step s JOIN albums a ON a.album_key = s.album_key WHERE a.usable
    """, ("v_messages",))
def group_albums(spark, folder):
    grouped = op.group_albums(timed_messages(spark, folder), sender_line(), RULES)
    return grouped.select("key", "album_key")


@query("dropped_albums", ALBUM_STEPS + """
    SELECT CASE WHEN n_images > 0 THEN 'dropped_all_missing' ELSE 'dropped_text_only' END AS reason, count(*) AS n
    FROM albums WHERE NOT usable GROUP BY 1""", ("v_messages",))
def dropped_albums(spark, folder):
    numbered = op.number_albums(timed_messages(spark, folder), sender_line(), RULES)
    return op.dropped_albums(op.album_table(numbered, sender_line().order))


@query("cap_messages", """
    SELECT post_id, seq, kind FROM (
      SELECT post_id, seq, kind, count(*) FILTER (kind = 'image') OVER (PARTITION BY post_id) AS images,
             row_number() OVER (PARTITION BY post_id, kind ORDER BY seq) AS rn FROM v_post_messages)
    WHERE kind = 'image' OR rn <= 4 - images""", ("v_post_messages",))
def cap_messages(spark, folder):
    return op.cap_messages(t.post_messages(spark, folder), ["post_id"], limit=4).select("post_id", "seq", "kind")


QUOTA, QUOTA_S = 4, 2 * 86400


@query("sliding_quota", f"""
    WITH RECURSIVE m AS (
      SELECT event_id, user_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn
      FROM events),
    step AS (
      SELECT event_id, user_id, rn, us, [us] AS held, true AS admitted, CAST(0 AS BIGINT) AS retry_after
      FROM m WHERE rn = 1
      UNION ALL
      SELECT m.event_id, m.user_id, m.rn, m.us,
             CASE WHEN len(f.alive) < {QUOTA} THEN list_append(f.alive, m.us) ELSE f.alive END,
             len(f.alive) < {QUOTA},
             CASE WHEN len(f.alive) < {QUOTA} THEN 0
                  ELSE greatest(1, CAST(ceil((f.alive[1] + {QUOTA_S} * 1000000::BIGINT - m.us) / 1000000.0) AS BIGINT))
             END
      FROM step s JOIN m ON m.user_id = s.user_id AND m.rn = s.rn + 1,
           LATERAL (SELECT list_filter(s.held, lambda x: x > m.us - {QUOTA_S} * 1000000::BIGINT) AS alive) f)
    SELECT event_id, admitted, retry_after FROM step""")
def sliding_quota(spark, folder):
    hits = t.load_table(spark, folder, "events").select(
        "event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"))
    line = chunked.Line(["user_id"], [F.col("at_us"), F.col("event_id")], F.floor(F.col("at_us") / 86_400_000_000))
    judged = op.sliding_quota(hits, line, "at_us", limit=QUOTA, window_s=QUOTA_S)
    return judged.select("event_id", "admitted", "retry_after")


@query("sliding_count", f"""
    SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts)
             RANGE BETWEEN {QUOTA_S * 1_000_000 - 1} PRECEDING AND CURRENT ROW) AS n FROM events""")
def sliding_count(spark, folder):
    """The monitoring form of the quota: hits of any kind in the trailing window."""
    hits = t.load_table(spark, folder, "events").select(
        "event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"))
    return chunked.trailing_count(hits, ["user_id"], F.col("at_us"), QUOTA_S * op.MICROS, "n").select("event_id", "n")
