"""Row rules: which messages, posts, files and listings pass, and why the others do not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bazaarlens.functions import captions
from bazaarlens.functions import text as tx
from bazaarlens.functions.ids import idempotency_key

# Limits and name lists of the ingest rules.
IMAGE_TYPES = ("image/jpeg", "image/png", "image/webp")
MAX_BACKLOG_S = 24 * 3600
MAX_KEY, MAX_CAPTION, MAX_POST_MESSAGES = 128, 4096, 60
EARLIEST_SENT = "2009-01-01 00:00:00"
MAX_FILE_BYTES = 15 * 1024 * 1024
REQUIRED_FIELDS = ("brand", "size", "price")
SEED_SOURCE = "demo_seed"
SIZE_SLACK = 1  # EU sizes, for sizes a model read

# Contact and secret patterns.
CONTACT_PATTERNS = {
    "phone": r"\+?\d[\d\s\-()]{7,}\d",
    "messenger_id": r"@s\.whatsapp\.net",
    "chat_link": r"wa\.me/",
    "url": r"(?i)https?://|www\.",
}
SELLER_NAME = r"^Demo Seller \d{1,2}$"
SECRET_PATTERNS = {
    "phone": r"(?<![\w./])\+?\d[\d\s\-()]{9,}\d(?![\w.])",
    "chat_id": r"@s\.whatsapp\.net|@g\.us|wa\.me/",
    "credential": r"(?i)(api[_-]?key|secret|token)\s*[=:]\s*['\"]?[A-Za-z0-9_\-]{24,}",
    "service_token": r"\b(sk|rc|hf)_[A-Za-z0-9]{20,}",
}
PRIVATE_PATHS = r"(^|/)(\.env[^/]*|auth[^/]*|data|exports|spool|state)(/|$)"


def classify_messages(msgs: DataFrame, *, group: str, now_s: Column, max_backlog_s: int = MAX_BACKLOG_S) -> DataFrame:
    """Adds `verdict`: image, text, or the first drop reason that applies. Privacy rules come before content rules.

    Expects remote, from_me, has_body, stub_type, delivery, ts_s, participant, view_once, content, mimetype, text."""
    is_photo = (F.col("content") == "image") | (
        (F.col("content") == "document") & F.col("mimetype").isin(*IMAGE_TYPES))
    said = (F.col("content") == "text") & (F.length("text") > 0)
    late = F.col("ts_s").isNull() | F.isnan(F.col("ts_s").cast("double")) | (
        now_s - F.col("ts_s") > max_backlog_s)
    verdict = (
        F.when(~F.col("remote").eqNullSafe(F.lit(group)), "other_chat")
        .when(F.coalesce(F.col("from_me"), F.lit(False)), "from_me")
        .when(~F.col("has_body") | F.col("stub_type").isNotNull(), "stub")
        .when(~F.coalesce(F.col("delivery").isin("notify", "append"), F.lit(False)), "unknown_type")
        .when(late, "too_old")
        .when(F.coalesce(F.col("participant"), F.lit("")) == "", "no_sender")
        .when(F.coalesce(F.col("view_once"), F.lit(False)), "view_once")
        .when(F.col("content").isNull(), "stub")
        .when(F.col("content") == "protocol", "protocol")
        .when(is_photo, "image")
        .when(said, "text")
        .otherwise(F.concat(F.lit("unsupported:"), F.col("content"))))
    return msgs.withColumn("verdict", verdict)


def drop_too_old(msgs: DataFrame, ts_s: Column, now_s: Column, max_backlog_s: int = MAX_BACKLOG_S) -> DataFrame:
    return msgs.where(ts_s.isNotNull() & ~F.isnan(ts_s.cast("double")) & (now_s - ts_s <= max_backlog_s))


def reason_counts(df: DataFrame, reason: str = "verdict") -> DataFrame:
    return df.groupBy(F.col(reason).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def validate_messages(msgs: DataFrame, now: Column) -> DataFrame:
    """Adds `problems`, the names of the broken rules; an empty array means valid.

    Expects key, kind, sent_at, caption, file_field, missing_media."""
    has_file = F.col("file_field").isNotNull()
    checks = {
        "bad_key": ~F.coalesce(F.length("key").between(1, MAX_KEY), F.lit(False)),
        "bad_kind": ~F.coalesce(F.col("kind").isin("image", "text"), F.lit(False)),
        "caption_too_long": F.coalesce(F.length("caption") > MAX_CAPTION, F.lit(False)),
        "sent_at_out_of_range": ~F.coalesce(
            (F.col("sent_at") >= F.lit(EARLIEST_SENT).cast("timestamp"))
            & (F.col("sent_at") <= now + F.expr("interval 1 day")), F.lit(False)),
        "text_with_media": (F.col("kind") == "text") & (has_file | F.col("missing_media")),
        "image_needs_file_xor_missing": (F.col("kind") == "image") & (has_file == F.col("missing_media")),
    }
    named = F.array(*[F.when(rule, F.lit(name)) for name, rule in checks.items()])
    return msgs.withColumn("problems", F.array_compact(named))


def validate_posts(msgs: DataFrame, post: list[str], *, claimed_key: str | None = None) -> DataFrame:
    """One row per post with its broken rules and recomputed key.

    Expects source, chat, key, kind, missing, file_field. Counting is partial per task; keys are collected only for
    the first 61 messages of a post, so a runaway post costs a group limit and is reported as too long."""
    totals = msgs.groupBy(*post).agg(
        F.count(F.lit(1)).alias("n_messages"), F.count_distinct("key").alias("n_keys"),
        F.count("file_field").alias("n_files"), F.count_distinct("file_field").alias("n_file_fields"),
        F.bool_or((F.col("kind") == "image") & ~F.col("missing")).alias("has_image"),
        F.min("source").alias("source"), F.min("chat").alias("chat"),
        *([F.min(claimed_key).alias("_claimed")] if claimed_key else []))
    head = bounded_keys(msgs, post)
    out = totals.join(head, post, "left")
    fits = F.col("n_messages") <= MAX_POST_MESSAGES
    key = F.when(fits, idempotency_key(F.col("source"), F.col("chat"), F.col("_keys")))
    checks = {
        "too_many_messages": ~fits,
        "duplicate_message_keys": F.col("n_keys") < F.col("n_messages"),
        "duplicate_file_fields": F.col("n_file_fields") < F.col("n_files"),
        "no_image_message": ~F.coalesce(F.col("has_image"), F.lit(False)),
    }
    if claimed_key:
        checks["key_mismatch"] = fits & ~F.col("_claimed").eqNullSafe(key)
    named = F.array(*[F.when(rule, F.lit(name)) for name, rule in checks.items()])
    return out.withColumn("idem_key", key).withColumn("problems", F.array_compact(named)).drop("_keys", "_claimed")


def bounded_keys(msgs: DataFrame, post: list[str], limit: int = MAX_POST_MESSAGES) -> DataFrame:
    """Message keys per post, at most limit + 1 of them; the extra one marks a post that is over the limit."""
    position = F.row_number().over(Window.partitionBy(*post).orderBy("key"))
    return (msgs.select(*post, F.col("key").cast("string").alias("key")).withColumn("_rn", position)
            .where(F.col("_rn") <= limit + 1).groupBy(*post).agg(F.collect_list("key").alias("_keys")))


def media_verdict(content: Column, size: Column, max_bytes: int = MAX_FILE_BYTES) -> Column:
    """too_large, bad_type or null, from the size and the first bytes only."""
    head = F.hex(F.substring(content, 1, 12))
    known = (head.startswith("FFD8FF") | head.startswith("89504E470D0A1A0A")
             | (head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250")))
    return F.when(size > max_bytes, "too_large").when(~F.coalesce(known, F.lit(False)), "bad_type")


def visible_to(df: DataFrame, owner: str | None) -> DataFrame:
    """No owner sees everything; an owner sees seed rows and their own."""
    if owner is None:
        return df
    return df.where((F.col("source") == SEED_SOURCE) | (F.col("owner_session") == owner))


def size_slack(size_source: Column) -> Column:
    return F.when(size_source == "vlm", F.lit(SIZE_SLACK)).otherwise(F.lit(0)).cast("decimal(4,1)")


def size_fits(size: Column, size_source: Column, low: Column, high: Column) -> Column:
    slack = size_slack(size_source)
    return low.isNull() | size.isNull() | size.between(low - slack, high + slack)


def price_fits(price: Column, ceiling: Column) -> Column:
    return ceiling.isNull() | price.isNull() | (price <= ceiling)


def brand_fits(brand: Column, wanted: Column) -> Column:
    return wanted.isNull() | F.coalesce(captions.brand_family(brand) == captions.brand_family(wanted), F.lit(False))


def listing_filters(listings: DataFrame, *, size_min=None, size_max=None, max_price=None, brand=None) -> DataFrame:
    """Unknown size or price passes, unknown brand does not; model-read sizes get one EU size of slack."""
    out = listings
    if size_min is not None:
        low, high = F.lit(size_min).cast("decimal(4,1)"), F.lit(size_max).cast("decimal(4,1)")
        out = out.where(size_fits(F.col("size_eu"), F.col("size_source"), low, high))
    if max_price is not None:
        out = out.where(price_fits(F.col("price"), F.lit(max_price)))
    if brand is not None:
        out = out.where(brand_fits(F.col("brand"), F.lit(brand)))
    return out


def group_date_range(groups: DataFrame, first_ts: Column, *, since=None, before=None, limit: int | None = None,
                     order: list[Column] | None = None) -> DataFrame:
    out = groups
    if since is not None:
        out = out.where(first_ts >= since)
    if before is not None:
        out = out.where(first_ts < before)
    return out if limit is None else out.orderBy(*order).limit(limit)


def needs_enrichment(df: DataFrame, *, policy: Column, provider: Column,
                     required: tuple[str, ...] = REQUIRED_FIELDS) -> DataFrame:
    """Adds needed, reason, missing. Expects brand, size_label, price, price_on_request, repost, no_shoe, multi_item
    and, where required, model, colour, condition."""
    def has(field: str) -> Column:
        if field == "price":
            return F.col("price").isNotNull() | F.coalesce(F.col("price_on_request"), F.lit(False))
        if field == "size":
            return F.coalesce(F.col("size_label"), F.lit("")) != ""
        return F.coalesce(F.col(field), F.lit("")) != ""

    missing = F.array_compact(F.array(*[F.when(~has(f), F.lit(f)) for f in required]))
    off = (policy == "never") | (provider == "off")
    reason = (F.when(off, "policy").when(F.col("repost"), "repost").when(F.col("no_shoe"), "no_shoe")
              .when(F.col("multi_item"), "multi_item").when(F.size(missing) == 0, "local_sufficient")
              .otherwise(F.concat(F.lit("missing:"), F.array_join(missing, ","))))
    needed = (reason == "multi_item") | reason.startswith("missing:")
    return (df.withColumn("needed", needed).withColumn("reason", reason)
            .withColumn("missing", F.when(reason.isin("policy", "repost", "no_shoe"), F.array().cast("array<string>"))
                        .otherwise(missing)))


def pii_scan(texts: DataFrame, id_col: str, text_col: str, seller_col: str | None = None) -> DataFrame:
    """One row per (text, finding)."""
    hits = [F.when(F.col(text_col).rlike(p), F.lit(name)) for name, p in CONTACT_PATTERNS.items()]
    if seller_col:
        hits.append(F.when(~F.col(seller_col).rlike(SELLER_NAME), F.lit("seller_name")))
    return texts.select(id_col, F.explode(F.array_compact(F.array(*hits))).alias("finding"))


def secret_scan(texts: DataFrame, id_col: str, text_col: str, path_col: str | None = None) -> DataFrame:
    """One row per (text, finding) with the 0-based offset of its first occurrence (-1 for a forbidden path)."""
    hits = [F.when(F.regexp_instr(F.col(text_col), F.lit(p)) > 0,
                   F.struct(F.lit(name).alias("finding"),
                            (F.regexp_instr(F.col(text_col), F.lit(p)) - 1).alias("at")))
            for name, p in SECRET_PATTERNS.items()]
    if path_col:
        hits.append(F.when(F.col(path_col).rlike(PRIVATE_PATHS),
                           F.struct(F.lit("private_path").alias("finding"), F.lit(-1).alias("at"))))
    return texts.select(id_col, F.inline(F.array_compact(F.array(*hits))))


def describe_match(df: DataFrame, *, app_name: str) -> DataFrame:
    """Adds title and body: text for a notification, from listing fields only.

    Expects brand, model, size_label, size_source, price, currency, repost_count."""
    name = F.concat_ws(" ", F.when(F.col("brand") != "", F.col("brand")), F.when(F.col("model") != "", F.col("model")))
    size = (F.when(F.coalesce(F.col("size_label"), F.lit("")) == "", "size unknown")
            .otherwise(F.concat(F.lit("Size "), F.col("size_label"),
                                F.when(F.col("size_source") == "vlm", " (read by AI)").otherwise(""))))
    currency = F.coalesce(F.col("currency"), F.lit(""))
    money = F.when(F.col("price").isNotNull(), F.concat_ws(
        " ", F.when(currency.isin("PKR", ""), "Rs").otherwise(currency), F.format_number(F.col("price"), 0)))
    times = F.when(F.coalesce(F.col("repost_count"), F.lit(0)) > 0, F.concat(
        F.lit("posted "), (F.col("repost_count") + 1).cast("string"), F.lit("×")))
    title = F.concat(F.lit(f"{app_name}: "), F.when(name == "", "A shoe").otherwise(name))
    return (df.withColumn("title", tx.notification_text(title, 80))
            .withColumn("body", tx.notification_text(F.concat_ws(" · ", size, money, times), 200)))
