"""Chat-export text: headers, formats, timestamps, messages, bodies and keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarlens.functions import ids
from bazaarlens.operators import chunked
PART_LINES = 65536


def occurrence_keys(msgs: DataFrame, chat: Column, position: Column) -> DataFrame:
    """Adds `occurrence` (0-based, per header, sender and body) and the synthetic `key`. Expects header, sender, ident.

    Repeats of one message may fill a chat, so the counter runs in chunks of the position."""
    line = chunked.Line(["header", "sender", "ident"], [position], chunked.by_rows(position))
    counted = chunked.row_number(msgs, line, "occurrence")
    return counted.withColumn("occurrence", F.col("occurrence") - 1).withColumn(
        "key", ids.occurrence_hash(chat, F.col("header"), F.col("sender"), F.col("ident"), F.col("occurrence")))


# Header, sender, attachment and marker patterns of chat exports.
DATE = r"(\d{1,4}[./-]\d{1,2}[./-]\d{2,4})"
CLOCK = r"(\d{1,2}[:.]\d{2}(?:[:.]\d{2})?(?:\s?[AaPp]\.?\s?[Mm]\.?)?)"
HEADERS = {
    "ios": r"(?U)^\[" + DATE + r",?\s" + CLOCK + r"\]\s(.*)$",
    "android": "(?U)^" + DATE + r",?\s" + CLOCK + r"\s[-–]\s(.*)$",
}
SENDER = r"(?U)^([^:]{1,80}):\s(.*)$"
HALF_DAY = r"(?U)\s?([AaPp])\.?\s?[Mm]\.?$"
ATTACHED_IOS = r"(?U)<attached:\s*([^>]+)>(.*)$"
ATTACHED_ANDROID = r"(?U)^([\w-]+\.\w{2,5})\s*\(.*\)\s*$"
IMAGE_NAME = r"(?i)\.(?:jpe?g|png|webp)$"
OTHER_NAME = r"(?i)(?:^|-)(?:STK|PTT|VID|AUD|STICKER|AUDIO|VIDEO|GIF)-"
OMITTED = (r"(?iU)^\s*(?:<media omitted>|image omitted|video omitted|sticker omitted|audio omitted|gif omitted|"
           r"document omitted)\s*$")
DELETED = r"(?iU)^\s*(?:this message was deleted\.?|you deleted this message\.?)\s*$"
EDITED = r"(?iU)\s*<this message was edited>\s*$"
PHONE = r"(?U)^\+?[\d\s()-]{8,}$"
PHONE_DOMAIN = "@s.whatsapp.net"


def parse_chat_headers(lines: DataFrame) -> DataFrame:
    """Adds, per known format, STRUCT<date, clock, rest> or null. Expects line."""
    def header(pattern: str) -> Column:
        parts = [F.regexp_extract("line", pattern, g + 1).alias(n) for g, n in enumerate(("date", "clock", "rest"))]
        return F.when(F.col("line").rlike(pattern), F.struct(*parts))
    return lines.withColumns({kind: header(p) for kind, p in HEADERS.items()})


def infer_chat_format(headers: DataFrame, date_order: str | None = None) -> DataFrame:
    """One row per file: kind, date_order, has_seconds, is_12h, problem.

    The kind is the one with most headers in the whole file; the date order follows from values above
    12 or a four-digit year anywhere in the file. Undecidable and contradictory files carry a problem."""
    hits = headers.where(F.trim("line") != "").groupBy("file").agg(*[F.count(k).alias(f"_{k}") for k in HEADERS])
    kinds = hits.select("file", F.when(F.col("_ios") + F.col("_android") == 0, None).when(
        F.col("_ios") >= F.col("_android"), "ios").otherwise("android").alias("kind"))

    def flags(kind: str) -> list[Column]:
        parts = F.split(f"{kind}.date", "[./-]")
        bare = F.regexp_replace(f"{kind}.clock", r"(?U)\s?[AaPp].*$", "")
        tests = {
            "year": F.length(F.get(parts, F.lit(0))) == 4, "first": F.get(parts, F.lit(0)).cast("int") > 12,
            "second": F.get(parts, F.lit(1)).cast("int") > 12, "seconds": F.size(F.split(bare, "[:.]")) == 3,
            "half": F.col(f"{kind}.clock").rlike(r"(?U)[AaPp]\.?\s?[Mm]")}
        return [F.coalesce(F.bool_or(c), F.lit(False)).alias(f"{kind}_{n}") for n, c in tests.items()]

    seen = headers.groupBy("file").agg(*flags("ios"), *flags("android")).join(kinds, "file", "left")

    def of(name: str) -> Column:
        return F.when(F.col("kind") == "ios", F.col(f"ios_{name}")).when(
            F.col("kind") == "android", F.col(f"android_{name}"))

    read = (F.when(of("year"), "ymd").when(of("first") & of("second"), None).when(of("first"), "dmy")
            .when(of("second"), "mdy"))
    order = F.lit(date_order) if date_order else read
    problem = F.when(F.col("kind").isNull(), "no_headers")
    if not date_order:
        problem = problem.when(~of("year") & of("first") & of("second"), "inconsistent_dates").when(
            read.isNull(), "needs_date_order")
    return seen.select("file", "kind", order.alias("date_order"), of("seconds").alias("has_seconds"),
                       of("half").alias("is_12h"), problem.alias("problem"))


def parse_chat_ts(date: Column, clock: Column, date_order: Column, tz: str) -> Column:
    """A timestamp from the parts of a header in the export's time zone."""
    d = F.transform(F.split(date, "[./-]"), lambda x: x.cast("int"))
    first, second, third = (F.get(d, F.lit(i)) for i in range(3))
    year = F.when(date_order == "ymd", first).otherwise(third)
    month = F.when(date_order == "mdy", first).otherwise(second)
    day = F.when(date_order == "ymd", third).when(date_order == "dmy", first).otherwise(second)
    year = F.when(year < 100, year + 2000).otherwise(year)
    half = F.lower(F.regexp_extract(clock, HALF_DAY, 1))
    c = F.transform(F.split(F.trim(F.regexp_replace(clock, HALF_DAY, "")), "[:.]"), lambda x: x.cast("int"))
    hour, minute = F.get(c, F.lit(0)), F.get(c, F.lit(1))
    hour = F.when(half == "p", hour % 12 + 12).when(half == "a", hour % 12).otherwise(hour)
    return F.try_make_timestamp(year, month, day, hour, minute, F.coalesce(F.get(c, F.lit(2)), F.lit(0)), F.lit(tz))


def assemble_messages(headers: DataFrame, formats: DataFrame, tz: str, part_lines: int = PART_LINES) -> DataFrame:
    """Messages of the files whose format is known: file, line_no (of the header), header, sender, ts, body, part.

    A message of more than `part_lines` lines is several rows, part 0, 1, 2, ... in order, so that no row and no task
    holds more lines than that; the parts joined by line breaks are the body. Any other message is one row.

    Lines after a header belong to its message; a header without a sender is a system message and goes with its
    continuation lines. Message numbers are a running count of headers, taken in chunks of lines for a long file."""
    known = headers.join(formats.where(F.col("problem").isNull()), "file")
    head = F.when(F.col("kind") == "ios", F.col("ios")).otherwise(F.col("android"))
    marked = known.withColumn("head", head).select("file", "line_no", "line", "head", "date_order")
    line = chunked.Line(["file"], [F.col("line_no")], chunked.by_rows(F.col("line_no")))
    numbered = chunked.running_sum(marked, line, F.col("head").isNotNull().cast("int"), "message_no")
    sender = F.regexp_extract("head.rest", SENDER, 1)
    text = F.when(F.col("head").isNotNull(), F.regexp_extract("head.rest", SENDER, 2)).otherwise(F.col("line"))
    spoken = F.col("head").isNotNull() & F.col("head.rest").rlike(SENDER)
    told = numbered.where("message_no > 0")
    heads = told.where(F.col("head").isNotNull()).select(
        "file", "message_no", F.col("line_no").alias("start"), F.when(spoken, F.trim(sender)).alias("sender"),
        F.col("head").alias("first"), F.col("date_order").alias("order"))
    placed = told.join(heads, ["file", "message_no"]).where(F.col("sender").isNotNull()).withColumn(
        "part", F.floor((F.col("line_no") - F.col("start")) / part_lines).cast("int"))
    messages = placed.groupBy("file", "message_no", "part").agg(
        F.min("start").alias("line_no"), F.max("sender").alias("sender"), F.max("first").alias("head"),
        F.max("order").alias("date_order"),
        F.sort_array(F.collect_list(F.struct("line_no", text.alias("text")))).alias("_lines"))  # part_lines at most
    return messages.select(
        "file", "line_no", F.concat_ws(" ", "head.date", "head.clock").alias("header"), "sender",
        parse_chat_ts(F.col("head.date"), F.col("head.clock"), F.col("date_order"), tz).alias("ts"),
        F.array_join(F.transform("_lines", lambda x: x["text"]), "\n").alias("body"), "part")


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def classify_body(msgs: DataFrame, media: DataFrame) -> DataFrame:
    """Adds kind (image, image_missing, other, omitted, deleted, text), filename and caption. `media`: name, and
    optionally length and reject_reason, which are carried along."""
    staged = msgs.withColumn("_body", F.regexp_replace("body", EDITED, ""))
    first = F.substring_index("_body", "\n", 1)
    rest = F.substring(F.col("_body"), F.length(first) + 2, F.length("_body"))
    staged = staged.withColumn("_first", first).withColumn("_rest", _strip(rest))
    ios = F.col("_first").rlike(ATTACHED_IOS)
    file = F.when(ios, _strip(F.regexp_extract("_first", ATTACHED_IOS, 1))).when(
        _strip(F.col("_first")).rlike(ATTACHED_ANDROID), F.regexp_extract(_strip(F.col("_first")), ATTACHED_ANDROID, 1))
    after = F.when(ios, _strip(F.regexp_extract("_first", ATTACHED_IOS, 2)))
    blank = lambda c: F.when(c != "", c)
    staged = staged.withColumn("filename", file).withColumn(
        "_cap", blank(F.concat_ws("\n", blank(after), blank(F.col("_rest")))))
    found = staged.join(media.withColumnRenamed("name", "filename").withColumn("_there", F.lit(True)), "filename", "left")
    photo = F.col("filename").rlike(IMAGE_NAME) & ~F.col("filename").rlike(OTHER_NAME)
    kind = (F.when(F.col("filename").isNotNull() & ~photo, "other")
            .when(F.col("filename").isNotNull(), F.when(F.col("_there"), "image").otherwise("image_missing"))
            .when(F.col("_first").rlike(OMITTED), F.when(F.col("_first").rlike("(?i)media|image"), "omitted")
                  .otherwise("other"))
            .when(F.col("_body").rlike(DELETED), "deleted").otherwise("text"))
    caption = F.when(F.col("kind").startswith("image"), F.col("_cap")).when(
        F.col("kind") == "text", blank(_strip(F.col("_body"))))
    return found.withColumn("kind", kind).withColumn("caption", caption).drop(
        "_body", "_first", "_rest", "_cap", "_there")


def sender_identity(raw: Column) -> Column:
    digits = F.concat(F.regexp_replace(raw, r"(?U)\D", ""), F.lit(PHONE_DOMAIN))
    return F.when(F.trim(raw).rlike(PHONE), digits).otherwise(F.concat(F.lit("name:"), raw))


def build_messages(classified: DataFrame, chat: Column) -> DataFrame:
    """Photos and texts as stream messages with stable keys. Expects file, line_no, header, sender, ts, body, kind,
    filename, caption; `bytes` and `reject_reason` are used if there."""
    kept = classified.where(F.col("kind").isin("image", "image_missing", "text")).withColumn(
        "ident", F.coalesce("filename", "body"))
    line = chunked.Line(["file", "header", "sender", "ident"], [F.col("line_no")], chunked.by_rows(F.col("line_no")))
    counted = chunked.row_number(kept, line, "_n").withColumn("occurrence", F.col("_n") - 1)
    reason = F.col("reject_reason") if "reject_reason" in classified.columns else F.lit(None).cast("string")
    size = F.col("length") if "length" in classified.columns else F.lit(0)
    missing = (F.col("kind") == "image_missing") | reason.isNotNull()
    return counted.select(
        "file", "line_no", ids.occurrence_hash(chat, F.col("header"), F.col("sender"), F.col("ident"),
                                               F.col("occurrence")).alias("key"),
        chat.alias("chat"), sender_identity(F.col("sender")).alias("sender"),
        F.unix_seconds("ts").cast("double").alias("ts_s"), F.col("ts"),
        F.when(F.col("kind") == "text", "text").otherwise("image").alias("kind"), "caption",
        F.when(missing, 0).otherwise(F.coalesce(size, F.lit(0))).cast("long").alias("bytes"), missing.alias("missing"),
        F.when(F.col("kind") == "image_missing", "download_failed").otherwise(reason).alias("reject_reason"))
