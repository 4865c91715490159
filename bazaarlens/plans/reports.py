"""Report queries: queues, spend, caps, evaluation, status, inventory and coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from bazaarlens.operators import attributes as attr
from bazaarlens.operators import chunked
from bazaarlens.operators import reports as op
from bazaarlens.operators import segments as seg
from bazaarlens.plans import caption_texts as ct
from bazaarlens.plans.registry import query
from bazaarlens.sources import tables as t

CALL_ORDER = ("ts", "call_id")


def _order():
    return [F.col(c) for c in CALL_ORDER]


@query("queue_status", """
    SELECT o_orderstatus AS status, coalesce(CASE WHEN o_orderkey % 4 > 0 THEN o_orderpriority END, '-') AS outcome,
           count(*) AS n FROM orders GROUP BY ALL""")
def queue_status(spark, folder):
    posts = t.load_table(spark, folder, "orders").select(
        F.col("o_orderstatus").alias("status"),
        F.when(F.col("o_orderkey") % 4 > 0, F.col("o_orderpriority")).alias("outcome"))
    return op.queue_status(posts, ["status", "outcome"])


@query("spend_today", """
    SELECT count(*) FILTER (status IN ('reserved', 'ok', 'bad_json', 'timeout')) AS calls,
           round(coalesce(sum(cost), 0), 6) AS cost FROM v_calls WHERE day = DATE '2024-01-15'""", ("v_calls",))
def spend_today(spark, folder):
    spent = op.spend_today(t.calls(spark, folder), F.lit("2024-01-15").cast("date"))
    return spent.withColumn("cost", F.round("cost", 6))


@query("spend_by_day", """
    SELECT CAST(day AS VARCHAR) AS day, count(*) FILTER (status IN ('reserved', 'ok', 'bad_json', 'timeout')) AS calls,
           round(sum(cost), 6) AS cost FROM v_calls GROUP BY day""", ("v_calls",))
def spend_by_day(spark, folder):
    return op.spend_by_day(t.calls(spark, folder)).select(
        F.col("day").cast("string").alias("day"), "calls", F.round("cost", 6).alias("cost"))


@query("attempt_number", """
    SELECT call_id, row_number() OVER (PARTITION BY post_id, segment_idx, prompt_version ORDER BY ts, call_id)
           + segment_idx % 3 AS attempt FROM v_calls""", ("v_calls",))
def attempt_number(spark, folder):
    rows = t.calls(spark, folder)
    stored = rows.select("post_id", "segment_idx", "prompt_version", (F.col("segment_idx") % 3).alias("attempt"))
    return op.attempt_number(rows, _order(), stored).select("call_id", "attempt")


DAY_CAP, SEGMENT_CAP = 150, 1


@query("admit_calls", f"""
    SELECT call_id, CASE WHEN sum(unit) OVER (PARTITION BY day ORDER BY ts, call_id ROWS UNBOUNDED PRECEDING) - unit
                              >= {DAY_CAP} THEN 'DAY_CAP'
                         WHEN NOT fits THEN 'POST_CAP' ELSE 'admitted' END AS decision
    FROM (SELECT *, CASE WHEN fits THEN billed ELSE 0 END AS unit FROM (
      SELECT *, sum(billed) OVER (PARTITION BY post_id, segment_idx ORDER BY ts, call_id ROWS UNBOUNDED PRECEDING)
                - billed < {SEGMENT_CAP} AS fits
      FROM (SELECT *, CASE WHEN status = 'http_error' THEN 0 ELSE 1 END AS billed FROM v_calls)))""", ("v_calls",))
def admit_calls(spark, folder):
    judged = op.admit_day(t.calls(spark, folder), _order(), day_cap=DAY_CAP, segment_cap=SEGMENT_CAP)
    return judged.select("call_id", "decision")


LONG_DAY_CAP, LONG_SEGMENT_CAP = 150, 40


@query("admit_calls_over_days", f"""
    WITH RECURSIVE c AS MATERIALIZED (
      SELECT call_id, day, status <> 'http_error' AS billed, dense_rank() OVER (ORDER BY post_id) AS seg,
             row_number() OVER (ORDER BY ts, call_id) AS rn FROM v_calls),
    step AS (
      SELECT 0::BIGINT AS rn, NULL::BIGINT AS call_id, NULL::DATE AS day, 0 AS spent, NULL::VARCHAR AS decision,
             list_transform(range((SELECT max(seg) FROM c)), lambda x: 0) AS used
      UNION ALL
      SELECT c.rn, c.call_id, c.day, f.before + CASE WHEN f.d = 'admitted' AND c.billed THEN 1 ELSE 0 END, f.d,
             CASE WHEN f.d = 'admitted' AND c.billed
                  THEN s.used[:c.seg - 1] || [s.used[c.seg] + 1] || s.used[c.seg + 1:] ELSE s.used END
      FROM step s JOIN c ON c.rn = s.rn + 1,
           LATERAL (SELECT CASE WHEN s.day IS NOT DISTINCT FROM c.day THEN s.spent ELSE 0 END AS before) g,
           LATERAL (SELECT g.before, CASE WHEN g.before >= {LONG_DAY_CAP} THEN 'DAY_CAP'
                                WHEN s.used[c.seg] >= {LONG_SEGMENT_CAP} THEN 'POST_CAP' ELSE 'admitted' END AS d) f)
    SELECT call_id, decision FROM step WHERE rn > 0""", ("v_calls",))
def admit_calls_over_days(spark, folder):
    """A user's calls are one segment, so segments span days, and day caps and segment caps push each other."""
    calls = t.calls(spark, folder).withColumn("segment_idx", F.lit(0))
    judged = op.admit_calls(calls, _order(), day_cap=LONG_DAY_CAP, segment_cap=LONG_SEGMENT_CAP)
    return judged.select("call_id", "decision")


@query("latest_ok_response", """
    SELECT post_id, segment_idx, prompt_version, last(call_id ORDER BY ts, call_id) AS call_id,
           last(props ORDER BY ts, call_id) AS response
    FROM v_calls WHERE status = 'ok' AND call_id % 5 <> 0 GROUP BY ALL""", ("v_calls",))
def latest_ok_response(spark, folder):
    rows = t.calls(spark, folder).withColumn("response", F.when(F.col("call_id") % 5 != 0, F.col("props")))
    return op.latest_ok_response(rows, _order())


@query("cost_estimate", """
    SELECT call_id, round(greatest(call_id % 3000, 600 + greatest(1, (call_id % 700 + 1) * 480 // 784)
                                   + greatest(1, (call_id % 13) // 784)) * 0.2 / 1e6
                          + (call_id % 300) * 0.6 / 1e6, 6) AS cost,
           round(call_id * (0.2 * 2200 + 0.6 * 250) / 1e6 * 1.1, 6) AS planned
    FROM v_calls""", ("v_calls",))
def cost_estimate(spark, folder):
    n = F.col("call_id")
    crops = F.array((n % 700 + 1) * 480, n % 13)
    price_in, price_out = F.lit(0.2), F.lit(0.6)
    return t.calls(spark, folder).select(
        n, op.cost_estimate(n % 3000, n % 300, crops, price_in, price_out).alias("cost"),
        F.round(op.planned_cost(n, price_in, price_out), 6).alias("planned"))


@query("post_outcome", """
    SELECT post_id, CASE WHEN min(match_kind) = max(match_kind) THEN min(match_kind) ELSE 'mixed' END AS outcome
    FROM v_sighting GROUP BY post_id""", ("v_sighting",))
def post_outcome(spark, folder):
    return op.post_outcome(t.sightings(spark, folder), ["post_id"], "match_kind")


@query("model_eval", """
    SELECT model, count(*) AS calls, round(100 * avg(CAST(status = 'ok' AS INTEGER)), 4) AS ok_pct,
           round(100 * avg(CASE WHEN status = 'ok' THEN CAST(call_id % 7 <> 0 AS INTEGER) END), 4) AS json_pct,
           round(100 * avg(CASE WHEN brand IS NOT NULL THEN CAST(coalesce(lower(got_brand) = lower(brand), false)
                                                            AS INTEGER) END), 4) AS brand_pct,
           round(100 * avg(CASE WHEN size_label IS NOT NULL THEN CAST(
             CASE WHEN size_eu IS NOT NULL AND got_eu IS NOT NULL THEN abs(got_eu - size_eu) <= 0.5
                  ELSE coalesce(replace(lower(got_label), ' ', ''), '') = replace(lower(size_label), ' ', '') END
             AS INTEGER) END), 4) AS size_pct,
           round(100 * avg(CAST(got_label IS NOT NULL AS INTEGER)), 4) AS size_answered_pct,
           median(CASE WHEN status = 'ok' THEN ms END) AS ms_median, max(CASE WHEN status = 'ok' THEN ms END) AS ms_max,
           round(avg(cost), 6) AS mean_cost
    FROM (SELECT c.*, call_id % 4000 AS ms, l.brand, CAST(l.size_eu AS DOUBLE) AS size_eu,
                 CASE WHEN l.size_eu IS NOT NULL THEN 'EU ' || CAST(l.size_eu AS INTEGER) END AS size_label,
                 CASE WHEN call_id % 3 <> 0 THEN 'BRAND#' || (call_id % 25 + 1) END AS got_brand,
                 CASE WHEN call_id % 4 <> 0 THEN call_id % 50 + 1.5 END::DOUBLE AS got_eu,
                 CASE WHEN call_id % 5 <> 0 THEN 'eu' || (call_id % 50 + 1) END AS got_label
          FROM v_calls c JOIN v_listing l ON l.listing_id = c.call_id % (SELECT count(*) FROM v_listing)) GROUP BY model""", ("v_calls", "v_listing"))
def model_eval(spark, folder):
    n = F.col("call_id")
    number = t.listings(spark, folder, with_vector=False).agg(F.count(F.lit(1)).alias("_listings"))  # one row
    predictions = t.calls(spark, folder).join(F.broadcast(number)).select(
        "model", "status", "cost", (n % F.col("_listings")).alias("listing_id"), (n % 7 != 0).alias("valid_json"),
        (n % 4000).alias("ms"), F.when(n % 3 != 0, F.concat(F.lit("BRAND#"), (n % 25 + 1).cast("string")))
        .alias("got_brand"), F.when(n % 4 != 0, n % 50 + 1.5).alias("got_eu"),
        F.when(n % 5 != 0, F.concat(F.lit("eu"), (n % 50 + 1).cast("string"))).alias("got_label"))
    truth = t.listings(spark, folder, with_vector=False).select(
        "listing_id", "brand", "size_eu",
        F.when(F.col("size_eu").isNotNull(), F.concat(F.lit("EU "), F.col("size_eu").cast("int").cast("string")))
        .alias("size_label"))
    return op.model_eval(predictions, truth, ["listing_id"])


@query("band_precision", """
    SELECT l.label AS band, count(*) AS pairs, count(q.doc_id) AS different,
           (count(*) - count(q.doc_id)) / count(*) AS precision
    FROM (SELECT doc_id, lang AS label FROM documents) l
    LEFT JOIN (SELECT doc_id FROM labels WHERE quality = 0) q ON q.doc_id = l.doc_id GROUP BY l.label""")
def band_precision(spark, folder):
    pairs = t.load_table(spark, folder, "documents").select("doc_id", F.col("lang").alias("band"))
    marks = t.load_table(spark, folder, "labels").where(F.col("quality") == 0)
    return op.band_precision(pairs, marks, ["doc_id"])


@query("duplicate_slugs", "SELECT p_name AS slug, count(*) AS n FROM part GROUP BY p_name HAVING count(*) > 1")
def duplicate_slugs(spark, folder):
    return op.duplicate_keys(t.load_table(spark, folder, "part").select(F.col("p_name").alias("slug")), "slug")


def beat_line():
    return chunked.Line(["source"], [F.col("ts"), F.col("beat_id")], chunked.by_days(F.col("ts"), 30))


@query("state_alerts", """
    SELECT beat_id, source, state FROM (
      SELECT *, lag(state) OVER (PARTITION BY source, epoch ORDER BY ts, beat_id) AS told FROM (
        SELECT *, sum(CASE WHEN state = 'open' THEN 1 ELSE 0 END)
                  OVER (PARTITION BY source ORDER BY ts, beat_id ROWS UNBOUNDED PRECEDING) AS epoch FROM v_beats)
      WHERE state IN ('logged_out', 'replaced', 'bad_session', 'forbidden', 'stopped')
        AND detail IS DISTINCT FROM 'shutdown')
    WHERE told IS DISTINCT FROM state""", ("v_beats",))
def state_alerts(spark, folder):
    return op.state_alerts(t.beats(spark, folder), beat_line()).select("beat_id", "source", "state")


@query("stale_status", """
    SELECT source, last(state ORDER BY ts, beat_id) AS state, epoch_us(max(ts)) AS beat_us,
           epoch_us(last(last_message_at ORDER BY ts, beat_id) FILTER (last_message_at IS NOT NULL)) AS message_us,
           epoch_us(TIMESTAMP '2024-01-31') / 1e6 - epoch_us(max(ts)) / 1e6 > 40000 AS stale
    FROM v_beats GROUP BY source""", ("v_beats",))
def stale_status(spark, folder):
    latest = op.stale_status(t.beats(spark, folder), F.lit("2024-01-31 00:00:00").cast("timestamp"),
                             [F.col("ts"), F.col("beat_id")], stale_s=40000)
    return latest.select("source", "state", F.unix_micros("last_heartbeat_at").alias("beat_us"),
                         F.unix_micros("last_message_at").alias("message_us"), "stale")


@query("reconcile_inventory", """
    WITH used AS (SELECT DISTINCT 'f' || l_partkey AS file FROM lineitem WHERE l_returnflag = 'A'),
    attributed AS (SELECT 'f' || p_partkey AS file, md5(p_name) AS want, p_partkey % 5 = 0 AS bad_license,
                          p_partkey % 6 = 0 AS bad_source FROM part WHERE p_partkey % 4 <> 0),
    disk AS (SELECT 'f' || p_partkey AS file, md5(CASE WHEN p_partkey % 9 = 0 THEN p_brand ELSE p_name END) AS got
             FROM part WHERE p_partkey % 3 <> 0),
    every AS (SELECT coalesce(u.file, a.file, d.file) AS file, u.file AS u, a.file AS a, d.file AS d, want, got,
                     bad_license, bad_source
              FROM used u FULL JOIN attributed a ON a.file = u.file
              FULL JOIN disk d ON d.file = coalesce(u.file, a.file))
    SELECT file, problem FROM (SELECT file, unnest([
      CASE WHEN u IS NOT NULL AND a IS NULL THEN 'no license row' END,
      CASE WHEN d IS NOT NULL AND a IS NULL THEN 'not attributed' END,
      CASE WHEN a IS NOT NULL AND d IS NULL THEN 'not on disk' END,
      CASE WHEN a IS NOT NULL AND bad_license THEN 'license not allowed' END,
      CASE WHEN a IS NOT NULL AND bad_source THEN 'author and https source required' END,
      CASE WHEN a IS NOT NULL AND d IS NOT NULL AND want <> got THEN 'sha256 mismatch' END]) AS problem FROM every)
    WHERE problem IS NOT NULL""")
def reconcile_inventory(spark, folder):
    named = lambda c: F.concat(F.lit("f"), c.cast("string"))
    used = t.load_table(spark, folder, "lineitem").where(F.col("l_returnflag") == "A").select(
        named(F.col("l_partkey")).alias("file"))
    part, n = t.load_table(spark, folder, "part"), F.col("p_partkey")
    rows = part.where(n % 4 != 0).select(
        named(n).alias("file"), F.md5("p_name").alias("sha256"),
        F.when(n % 5 == 0, "GPL").otherwise("CC-BY-4.0").alias("license"), F.lit("someone").alias("author"),
        F.when(n % 6 == 0, "http://x").otherwise("https://x").alias("source_url"))
    disk = part.where(n % 3 != 0).select(
        named(n).alias("file"), F.md5(F.when(n % 9 == 0, F.col("p_brand")).otherwise(F.col("p_name"))).alias("sha256"))
    return op.reconcile_inventory(used, rows, disk)


@query("eval_sample", """
    WITH pool AS (
      SELECT listing_id, CASE WHEN size_source IN ('caption', 'ocr') AND size_eu IS NOT NULL THEN 'size' ELSE 'brand' END
             AS stratum
      FROM v_listing WHERE (size_source IN ('caption', 'ocr') AND size_eu IS NOT NULL)
                        OR brand_source IN ('caption', 'ocr')),
    drawn AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('11:' || listing_id)) AS place FROM pool)
    SELECT listing_id, stratum, place FROM drawn WHERE place <= CASE stratum WHEN 'size' THEN 20 ELSE 10 END
    """, ("v_listing",))
def eval_sample(spark, folder):
    rows = t.listings(spark, folder, with_vector=False).withColumn("has_size", F.col("size_eu").isNotNull())
    return op.eval_sample(rows, n=30, seed=11).select("listing_id", "stratum", "place")


@query("coverage_report", f"""
    WITH parsed AS ({ct.caption_sql("o_orderkey", "orders", "o_orderkey AS id, o_orderdate AS made")}),
    flags AS (SELECT id, made, brand IS NOT NULL AS b, size_value IS NOT NULL AS s, price IS NOT NULL OR on_request AS p
              FROM parsed),
    gaps AS (SELECT *, 3 - b::INT - s::INT - p::INT AS g FROM flags),
    totals AS (SELECT count(*) AS n, count(*) FILTER (b) AS nb, count(*) FILTER (s) AS ns, count(*) FILTER (p) AS np,
                      CAST(round_even(count(*) FILTER (g >= 2) * 1.1::DOUBLE, 0) AS BIGINT) AS lower,
                      CAST(round_even(count(*) FILTER (g >= 1) * 1.1::DOUBLE, 0) AS BIGINT) AS likely FROM gaps)
    SELECT n AS posts, n AS segments, n AS images,
           CAST(round_even(100 * nb / n, 0) AS BIGINT) AS brand_pct, CAST(round_even(100 * ns / n, 0) AS BIGINT) AS size_pct,
           CAST(round_even(100 * np / n, 0) AS BIGINT) AS price_pct, lower AS calls_lower, likely AS calls_likely,
           round(likely * 0.0020::DOUBLE, 4) AS cost_qwen2_5_vl_72b_instruct,
           CAST(round_even(n * 0.5::DOUBLE / 60, 0) AS BIGINT) AS minutes_low,
           CAST(round_even(n * 1.5::DOUBLE / 60, 0) AS BIGINT) AS minutes_high,
           (SELECT epoch_us(min(made)) FROM flags) AS first_us, (SELECT epoch_us(max(made)) FROM flags) AS last_us
    FROM totals""")
def coverage_report(spark, folder):
    """An import estimate: every order is a post of one photo with a composed caption."""
    rows = attr.caption_attributes(ct.seller_captions(spark, folder), "caption", "c")
    flags = rows.select(F.col("c_brand").isNotNull().alias("has_brand"),
                        F.col("c_size.value").isNotNull().alias("has_size"),
                        (F.col("c_price.price").isNotNull() | F.col("c_price.on_request")).alias("has_price"))
    at = F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    posts = t.load_table(spark, folder, "orders").select(
        F.lit(1).alias("n_images"), at.alias("first_ts"), at.alias("last_ts"))
    report = op.coverage_report(flags, posts)
    return report.select("posts", "segments", "images", "brand_pct", "size_pct", "price_pct", "calls_lower",
                         "calls_likely", "cost_qwen2_5_vl_72b_instruct", "minutes_low", "minutes_high",
                         F.col("first_ts").alias("first_us"), F.col("last_ts").alias("last_us"))


@query("segment_coverage")
def segment_coverage(spark, folder):
    """Posts from conversations through segmentation, caption reading and the post's extra text."""
    m = t.post_messages(spark, folder)
    msgs = m.withColumn("image_id", F.when((F.col("kind") == "image") & ~F.col("missing"), F.col("message_id")))
    line = seg.post_line(msgs)
    runs = seg.number_segments(seg.run_table(seg.image_runs(msgs, line)))
    joined = runs.join(seg.post_extra_text(msgs, line), "post_id", "left")
    read = attr.caption_attributes(attr.caption_attributes(joined, "segment_caption", "c"), "extra_text", "e")
    flags = attr.caption_fallback(read, "c", "e").select(
        "post_id", F.col("brand").isNotNull().alias("has_brand"), F.col("size_label").isNotNull().alias("has_size"),
        (F.col("price_amount").isNotNull() | F.col("price_on_request")).alias("has_price"))
    posts = msgs.groupBy("post_id").agg(F.count("image_id").alias("n_images"), F.min("seq").alias("first_ts"),
                                        F.max("seq").alias("last_ts"))
    return op.coverage_report(flags, posts)
