"""Ledgers and reports: queues, spend caps, evaluation, estimates, status and inventory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bazaarlens.functions import captions
from bazaarlens.functions.ids import stable_order_hash
from bazaarlens.operators import chunked
from bazaarlens.operators.chunked import Line
from bazaarlens.session import cut_lineage
from bazaarlens.sources.tables import first_rows

# Billing, planning and status constants.
BILLABLE = ("reserved", "ok", "bad_json", "timeout")
SEGMENT_CAP, DAY_CAP = 3, 2000
PIXELS_PER_TOKEN, PROMPT_TOKENS = 28 * 28, 600
PLAN_IN, PLAN_OUT, PLAN_OVERHEAD = 2200, 250, 1.1
CALL_COST = {"qwen/qwen2.5-vl-72b-instruct": 0.0020, "qwen/qwen3-vl-8b-instruct": 0.00034,
             "qwen/qwen3-vl-32b-instruct": 0.00033}
LOCAL_SECONDS_PER_POST = (0.5, 1.5)
STALE_S = 180
BAD_STATES = ("logged_out", "replaced", "bad_session", "forbidden", "stopped")
LICENSES = ("CC0-1.0", "CC-BY-2.0", "CC-BY-4.0", "CC-BY-SA-2.0", "CC-BY-SA-4.0", "Unsplash", "Pexels", "Own")


def queue_status(posts: DataFrame, by: list[str]) -> DataFrame:
    named = [F.coalesce(F.col(c), F.lit("-")).alias(c) for c in by]
    return posts.groupBy(*named).agg(F.count(F.lit(1)).alias("n"))


def spend_by_day(calls: DataFrame) -> DataFrame:
    billed = F.col("status").isin(*BILLABLE)
    return calls.groupBy("day").agg(F.count_if(billed).alias("calls"),
                                    F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"))


def spend_today(calls: DataFrame, today: Column) -> DataFrame:
    """One row: calls that may have been billed today, and the day's cost."""
    return calls.where(F.col("day") == today).agg(
        F.count_if(F.col("status").isin(*BILLABLE)).alias("calls"),
        F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"))


def attempt_number(calls: DataFrame, order: list[Column], stored: DataFrame | None = None) -> DataFrame:
    """Adds `attempt`, counting on from the highest stored one per (post, segment, prompt version)."""
    key = ["post_id", "segment_idx", "prompt_version"]
    line = Line(key, order, chunked.by_days(F.col("ts")))
    numbered = chunked.row_number(calls, line, "attempt")
    if stored is None:
        return numbered
    prior = stored.groupBy(*key).agg(F.max("attempt").alias("_prior"))
    return numbered.join(prior, key, "left").withColumn(
        "attempt", F.col("attempt") + F.coalesce("_prior", F.lit(0))).drop("_prior")


def admit_day(calls: DataFrame, order: list[Column], *, day_cap: int = DAY_CAP, segment_cap: int = SEGMENT_CAP
              ) -> DataFrame:
    """Adds `decision` to calls asked for in order: admitted, DAY_CAP or POST_CAP. Exact while a segment's calls fall
    on one day; `admit_calls` takes any.

    A call that was not billed (an error) uses up neither cap. A call over its segment's cap uses no unit of the day, so
    the segment cap is ranked first and the day counts the survivors. The day line is cut by the hour."""
    segment = ["post_id", "segment_idx"]
    billed = F.col("status").isin(*BILLABLE).cast("long")
    hour = F.floor(F.unix_seconds("ts") / 3600)
    in_segment = chunked.running_sum(calls, Line(segment, order, hour), billed, "_mine")
    fits = (F.col("_mine") - billed) < segment_cap
    counted = in_segment.withColumn("_unit", F.when(fits, billed).otherwise(0)).withColumn("_fits", fits)
    in_day = chunked.running_sum(counted, Line(["day"], order, hour), F.col("_unit"), "_spent")
    before = F.col("_spent") - F.col("_unit")
    decision = F.when(before >= day_cap, "DAY_CAP").when(~F.col("_fits"), "POST_CAP").otherwise("admitted")
    return in_day.withColumn("decision", decision).drop("_mine", "_unit", "_fits", "_spent")


def latest_ok_response(calls: DataFrame, order: list[Column]) -> DataFrame:
    key = ["post_id", "segment_idx", "prompt_version"]
    good = calls.where((F.col("status") == "ok") & F.col("response").isNotNull())
    place = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    return good.groupBy(*key).agg(F.max_by(F.struct("call_id", "response"), place).alias("_r")).select(
        *key, F.col("_r.call_id").alias("call_id"), F.col("_r.response").alias("response"))


def cost_estimate(tokens_in: Column, tokens_out: Column, crop_pixels: Column, price_in: Column, price_out: Column
                  ) -> Column:
    """Dollars per call to six places. `crop_pixels` is an array of width x height; input tokens are at least what the
    crops need, because some providers under-report them."""
    least = F.aggregate(F.transform(crop_pixels, lambda p: F.greatest(F.lit(1), F.floor(p / PIXELS_PER_TOKEN))),
                        F.lit(0).cast("long"), lambda acc, x: acc + x) + PROMPT_TOKENS
    used = F.greatest(F.coalesce(tokens_in, F.lit(0)), least)
    return F.round(used * price_in / 1e6 + F.coalesce(tokens_out, F.lit(0)) * price_out / 1e6, 6)


def planned_cost(calls: Column, price_in: Column, price_out: Column) -> Column:
    return calls * (price_in * PLAN_IN + price_out * PLAN_OUT) / 1e6 * PLAN_OVERHEAD


def coverage_report(segments: DataFrame, posts: DataFrame) -> DataFrame:
    """One row about an import: posts, segments, photos, date range, share of segments with each field, and how many
    enrichment calls are likely (a field missing) or certain (two missing), with 10 % overhead and half-even rounding.

    Segments: has_brand, has_size, has_price; posts: n_images, first_ts, last_ts."""
    gaps = (3 - F.col("has_brand").cast("int") - F.col("has_size").cast("int") - F.col("has_price").cast("int"))
    s = segments.agg(
        F.count(F.lit(1)).alias("segments"), F.count_if("has_brand").alias("with_brand"),
        F.count_if("has_size").alias("with_size"), F.count_if("has_price").alias("with_price"),
        F.count_if(gaps >= 1).alias("_likely"), F.count_if(gaps >= 2).alias("_lower"))
    p = posts.agg(F.count(F.lit(1)).alias("posts"), F.sum("n_images").alias("images"),
                  F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))
    calls = {n: F.bround(F.col(f"_{n}") * 1.1).cast("long") for n in ("lower", "likely")}
    one = p.join(F.broadcast(s))  # both sides are one row
    low, high = LOCAL_SECONDS_PER_POST
    return one.select(
        "posts", "segments", "images", "first_ts", "last_ts",
        *[F.bround(100 * F.col(f"with_{f}") / F.col("segments")).cast("long").alias(f"{f}_pct")
          for f in ("brand", "size", "price")],
        calls["lower"].alias("calls_lower"), calls["likely"].alias("calls_likely"),
        *[F.round(calls["likely"] * c, 4).alias("cost_" + m.split("/")[-1].replace("-", "_").replace(".", "_"))
          for m, c in CALL_COST.items()],
        F.bround(F.col("posts") * low / 60).cast("long").alias("minutes_low"),
        F.bround(F.col("posts") * high / 60).cast("long").alias("minutes_high"))


def post_outcome(segments: DataFrame, post: list[str], kind: str) -> DataFrame:
    same = F.min(kind) == F.max(kind)
    return segments.groupBy(*post).agg(F.when(same, F.min(kind)).otherwise("mixed").alias("outcome"))


def model_eval(predictions: DataFrame, truth: DataFrame, item: list[str]) -> DataFrame:
    """Per model: calls, shares answered and right, latency and cost. A size is right within half an EU size, else if
    the labels agree up to spaces and case. Predictions: model, status, valid_json, ms, cost, got_brand, got_eu,
    got_label; truth: brand, size_eu, size_label."""
    rows = predictions.join(truth, item)
    ok = F.col("status") == "ok"
    brand_ok = F.when(F.col("brand").isNotNull(), F.coalesce(
        captions.brand_family(F.col("got_brand")) == captions.brand_family(F.col("brand")), F.lit(False)))
    plain = lambda c: F.lower(F.replace(F.coalesce(c, F.lit("")), F.lit(" "), F.lit("")))
    both = F.col("size_eu").isNotNull() & F.col("got_eu").isNotNull()
    near = F.abs(F.col("got_eu").cast("double") - F.col("size_eu").cast("double")) <= 0.5
    size_ok = F.when(F.col("size_label").isNotNull(), F.when(both, near).otherwise(
        plain(F.col("got_label")) == plain(F.col("size_label"))))
    share = lambda c: F.round(100 * F.avg(c.cast("int")), 4)
    summed = rows.groupBy("model").agg(
        F.count(F.lit(1)).alias("calls"), share(ok).alias("ok_pct"),
        share(F.when(ok, F.coalesce(F.col("valid_json"), F.lit(False)))).alias("json_pct"),
        share(brand_ok).alias("brand_pct"), share(size_ok).alias("size_pct"),
        share(F.col("got_label").isNotNull()).alias("size_answered_pct"),
        F.max(F.when(ok, F.col("ms"))).alias("ms_max"), F.round(F.avg("cost"), 6).alias("mean_cost"))
    return chunked.joined(summed, exact_median(rows.where(ok), "model", "ms").withColumnRenamed("median", "ms_median"), ["model"])


def exact_median(rows: DataFrame, key: str, value: str, width: int = 1024) -> DataFrame:
    """(key, median) of a whole-number column: the middle value, or the midpoint of the two middle ones. Rows are counted
    per distinct value, and a running sum over the values, in chunks, tells where the middle lies; no value list is held."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("_n"))
    line = Line([key], [F.col(value)], F.floor(F.col(value) / width))
    upto = chunked.running_sum(counts, line, F.col("_n"), "_upto")
    total = counts.groupBy(key).agg(F.sum("_n").alias("_all"))
    placed = chunked.joined(upto, total, [key])
    low = F.min(F.when(F.col("_upto") >= F.floor((F.col("_all") + 1) / 2), F.col(value)))
    high = F.min(F.when(F.col("_upto") >= F.floor(F.col("_all") / 2) + 1, F.col(value)))
    return placed.groupBy(key).agg(((low + high) / 2).alias("median"))


def band_precision(pairs: DataFrame, marks: DataFrame, key: list[str]) -> DataFrame:
    """Per band: reviewed pairs, those marked different, and the share that shows one item."""
    joined = pairs.join(marks.select(*key, F.lit(1).alias("_different")), key, "left")
    n, d = F.count(F.lit(1)), F.count("_different")
    return joined.groupBy("band").agg(n.alias("pairs"), d.alias("different"), ((n - d) / n).alias("precision"))


def duplicate_keys(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def state_alerts(beats: DataFrame, line: Line) -> DataFrame:
    """One alert per entry into a bad state: the same state again is silent until the source was open in between. A
    deliberate shutdown never alerts. Expects state and detail."""
    epochs = chunked.running_sum(beats, line, (F.col("state") == "open").cast("int"), "_epoch")
    eligible = epochs.where(F.col("state").isin(*BAD_STATES) & ~F.col("detail").eqNullSafe("shutdown"))
    inner = Line([*line.keys, "_epoch"], line.order, line.chunk)
    seen = chunked.previous(eligible, inner, F.col("state"), "_told")
    return seen.where(~F.col("state").eqNullSafe(F.col("_told"))).drop("_told", "_epoch")


def stale_status(beats: DataFrame, now: Column, order: list[Column], stale_s: int = STALE_S) -> DataFrame:
    """The latest heartbeat per source, its age and whether it is stale; the last message time survives beats that
    carry none."""
    place = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    latest = beats.groupBy("source").agg(
        F.max_by(F.struct("state", "detail", "ts"), place).alias("_b"),
        F.max_by("last_message_at", F.when(F.col("last_message_at").isNotNull(), place)).alias("last_message_at"))
    age = F.unix_micros(now) / 1e6 - F.unix_micros("_b.ts") / 1e6
    return latest.select("source", F.col("_b.state").alias("state"), F.col("_b.detail").alias("detail"),
                         F.col("_b.ts").alias("last_heartbeat_at"), "last_message_at", age.alias("age_s"),
                         (age > stale_s).alias("stale"))


def reconcile_inventory(used: DataFrame, rows: DataFrame, disk: DataFrame) -> DataFrame:
    """One row per (file, problem) between what a manifest uses, what the attribution lists and what is on disk.

    used: file; rows: file, sha256, license, author, source_url; disk: file, sha256."""
    u = used.select("file").distinct().withColumn("_used", F.lit(True))
    r = rows.withColumn("_row", F.lit(True)).withColumnRenamed("sha256", "_want")
    d = disk.withColumn("_disk", F.lit(True)).withColumnRenamed("sha256", "_got")
    every = u.join(r, "file", "full_outer").join(d, "file", "full_outer")
    has = {c: F.coalesce(F.col(c), F.lit(False)) for c in ("_used", "_row", "_disk")}
    bad_source = (F.trim(F.coalesce("author", F.lit(""))) == "") | ~F.coalesce(
        F.col("source_url").startswith("https://"), F.lit(False))
    checks = {
        "no license row": has["_used"] & ~has["_row"], "not attributed": has["_disk"] & ~has["_row"],
        "not on disk": has["_row"] & ~has["_disk"],
        "license not allowed": has["_row"] & ~F.coalesce(F.col("license").isin(*LICENSES), F.lit(False)),
        "author and https source required": has["_row"] & bad_source,
        "sha256 mismatch": has["_row"] & has["_disk"] & ~F.col("_want").eqNullSafe(F.col("_got")),
    }
    named = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in checks.items()]))
    return every.select("file", F.explode(named).alias("problem"))


def eval_sample(listings: DataFrame, n: int, seed: int, sourced: tuple[str, ...] = ("caption", "ocr")) -> DataFrame:
    """A repeatable sample of n listings with text-derived labels: up to two thirds with a known size, then brand-only
    ones. Each stratum is a top-k in md5 order."""
    sized = F.col("size_source").isin(*sourced) & F.col("has_size")
    pool = listings.where(sized | F.col("brand_source").isin(*sourced)).withColumn(
        "stratum", F.when(sized, "size").otherwise("brand"))
    drawn = first_rows(pool, ["stratum"], [stable_order_hash(F.lit(seed), F.col("listing_id"))], n, "place")
    quota = 2 * n // 3
    taken = F.least(F.lit(quota), F.count_if(F.col("stratum") == "size").over(Window.partitionBy()))
    small = drawn.where((F.col("stratum") == "brand") | (F.col("place") <= quota))  # at most n + quota rows
    return small.withColumn("_taken", taken).where(
        (F.col("stratum") == "size") | (F.col("place") <= F.lit(n) - F.col("_taken"))).drop("_taken")


def admit_calls(calls: DataFrame, order: list[Column], *, day_cap: int = DAY_CAP, segment_cap: int = SEGMENT_CAP
                ) -> DataFrame:
    """Adds `decision` to calls asked for in order, where segments may span days.

    A segment's counter saturates at its cap, so its days compose to sums: what it has used before a day is the number
    of its billed calls that earlier days let through, up to the cap. A day lets calls through up to the one that finds
    the day's cap spent. All days are judged at once for given day ends; new day ends come out, and a round more of days
    is exact each time, so they are fixed after a few rounds, or after as many as there are days with a spent cap in a
    row at most. Inside a round, segments and days are scanned in chunks of an hour."""
    segment = ["post_id", "segment_idx"]
    hour = F.floor(F.unix_seconds("ts") / 3600)
    place = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    billed = calls.withColumn("_billed", F.col("status").isin(*BILLABLE).cast("long")).withColumn("_place", place)
    mine = cut_lineage(chunked.running_sum(billed, Line([*segment, "day"], order, hour), F.col("_billed"), "_mine"))
    ends = mine.select("day").distinct().withColumn("_end", F.lit(None).cast(mine.schema["_place"].dataType))
    seen = None
    while True:
        through = chunked.joined(mine.select(*segment, "day", "_billed", "_place"), ends, ["day"]).where(
            F.col("_end").isNull() | (F.col("_place") < F.col("_end")))
        let = through.groupBy(*segment, "day").agg(F.sum("_billed").alias("_let"))
        earlier = Window.partitionBy(*segment).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
        used = mine.select(*segment, "day").distinct()
        used = chunked.joined(used, let, [*segment, "day"]).withColumn("_used", F.coalesce(F.sum("_let").over(earlier), F.lit(0)))
        judged = chunked.joined(mine, used.drop("_let"), [*segment, "day"]).withColumn(
            "_fits", F.col("_used") + F.col("_mine") - F.col("_billed") < segment_cap)
        judged = chunked.running_sum(judged, Line(["day"], order, hour), F.when(F.col("_fits"), F.col("_billed")).otherwise(0),
                                     "_spent")
        before = F.col("_spent") - F.when(F.col("_fits"), F.col("_billed")).otherwise(0)
        judged = cut_lineage(judged.withColumn("decision", F.when(before >= day_cap, "DAY_CAP").when(
            ~F.col("_fits"), "POST_CAP").otherwise("admitted")))
        ends = cut_lineage(judged.groupBy("day").agg(
            F.min(F.when(F.col("decision") == "DAY_CAP", F.col("_place"))).alias("_end")))
        mark = tuple(ends.agg(F.count("_end"), F.sum(F.xxhash64("day", "_end").cast("decimal(38,0)"))).first())
        if mark == seen:
            return judged.select(*calls.columns, "decision")
        seen = mark
