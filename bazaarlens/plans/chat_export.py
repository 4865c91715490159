"""Chat-export queries: conversations are written as export files in the shared folder and read back.

The files are derived from the table, so the oracle knows every message."""

from __future__ import annotations

from pyspark.sql import functions as F

from bazaarlens.operators import chat_export as op
from bazaarlens.plans.registry import query
from bazaarlens.session import cut_lineage, fresh_path
from bazaarlens.sources import files
from bazaarlens.sources import tables as t

TZ = "Asia/Karachi"

# Bodies by turn: photos (present or not), other media, markers and plain text.
BODY_SQL = """
    CASE WHEN turn % 8 = 0 THEN 'IMG-20240314-WA' || lpad(CAST(conv_id % 40 AS VARCHAR), 4, '0')
              || '.jpg (file attached)' || chr(10) || text
         WHEN turn % 8 = 1 THEN text WHEN turn % 8 = 2 THEN '<Media omitted>'
         WHEN turn % 8 = 3 THEN '<attached: 0000001' || (conv_id % 10) || '-PHOTO-2024.jpg>' || chr(10) || text
         WHEN turn % 8 = 4 THEN 'This message was deleted' WHEN turn % 8 = 5 THEN 'PTT-20240314-WA0002.opus (file attached)'
         WHEN turn % 8 = 6 THEN text || ' <This message was edited>' ELSE 'video omitted' END"""
ROWS_SQL = f"""
    SELECT conv_id, conv_id // 50 AS file_no, conv_id // 50 % 2 = 0 AS ios, turn, text, role, {BODY_SQL} AS body,
           CASE WHEN role = 'user' THEN '+92 300 12345' || lpad(CAST(conv_id % 100 AS VARCHAR), 2, '0') ELSE 'Seller ' || role
           END AS sender FROM conversations"""


def _rows(spark, folder):
    n, conv, text = F.col("turn"), F.col("conv_id"), F.col("text")
    s = lambda c: c.cast("string")
    body = (F.when(n % 8 == 0, F.concat(F.lit("IMG-20240314-WA"), F.lpad(s(conv % 40), 4, "0"),
                                        F.lit(".jpg (file attached)\n"), text))
            .when(n % 8 == 1, text).when(n % 8 == 2, "<Media omitted>")
            .when(n % 8 == 3, F.concat(F.lit("<attached: 0000001"), s(conv % 10), F.lit("-PHOTO-2024.jpg>\n"), text))
            .when(n % 8 == 4, "This message was deleted").when(n % 8 == 5, "PTT-20240314-WA0002.opus (file attached)")
            .when(n % 8 == 6, F.concat(text, F.lit(" <This message was edited>"))).otherwise("video omitted"))
    sender = F.when(F.col("role") == "user", F.concat(F.lit("+92 300 12345"), F.lpad(s(conv % 100), 2, "0"))).otherwise(
        F.concat(F.lit("Seller "), F.col("role")))
    return t.load_table(spark, folder, "conversations").withColumn("body", body).withColumn("sender", sender)


def write_exports(spark, folder) -> str:
    """One file per fifty conversations: even files in the iOS form (12 h clock), odd ones in the Android form. Every
    file opens with a system line."""
    n, conv = F.col("turn"), F.col("conv_id")
    file_no = F.floor(conv / 50)
    is_ios = file_no % 2 == 0
    ios = F.concat(F.lit("[14/03/24, "), (n + 1).cast("string"), F.lit(":05:09 PM] "), F.col("sender"), F.lit(": "),
                   F.lit("‎"), F.col("body"))
    android = F.concat(F.lit("14/03/24, "), F.lpad((n + 8).cast("string"), 2, "0"), F.lit(":05 - "), F.col("sender"),
                       F.lit(": "), F.col("body"))
    rows = _rows(spark, folder).select(file_no.alias("file_no"), conv, n, F.when(is_ios, ios).otherwise(android)
                                       .alias("value"))
    opening = rows.select("file_no").distinct().select(
        "file_no", F.lit(-1).cast("long").alias("conv_id"), F.lit(-1).cast("long").alias("turn"),
        F.when(F.col("file_no") % 2 == 0, "[14/03/24, 1:00:00 PM] Messages are end-to-end encrypted.").otherwise(
            "14/03/24, 07:00 - Messages are end-to-end encrypted.").alias("value"))
    path = fresh_path(spark, "exports")
    (rows.unionByName(opening).repartition("file_no").sortWithinPartitions("file_no", "conv_id", "turn")
     .select("file_no", "value").write.partitionBy("file_no").text(path))
    return path


def _lines(spark, folder):
    """The numbered lines, written once: formats and messages read them several times."""
    return cut_lineage(files.read_chat_lines(spark, write_exports(spark, folder) + "/file_no=*"))


def file_no_of(file):
    return F.regexp_extract(file, r"file_no=(\d+)", 1).cast("long")


def _headers(spark, folder):
    return op.parse_chat_headers(_lines(spark, folder))


def _media(spark, folder):
    """The media folder's index: half the photo names are there."""
    part = t.load_table(spark, folder, "part")
    n = F.col("p_partkey")
    name = F.concat(F.lit("IMG-20240314-WA"), F.lpad((n % 40).cast("string"), 4, "0"), F.lit(".jpg"))
    return part.where(n % 2 == 0).select(name.alias("name")).distinct().withColumn("length", F.lit(1000))


def _messages(spark, folder):
    heads = _headers(spark, folder)
    return op.assemble_messages(heads, op.infer_chat_format(heads), TZ)


def _classified(spark, folder):
    return op.classify_body(_messages(spark, folder), _media(spark, folder))


@query("read_chat_lines", f"""
    WITH bodies AS (
      SELECT file_no, conv_id, turn, string_split(CASE WHEN ios THEN '[14/03/24, ' || (turn + 1) || ':05:09 PM] '
               ELSE '14/03/24, ' || lpad(CAST(turn + 8 AS VARCHAR), 2, '0') || ':05 - ' END || sender || ': ' || body,
               chr(10)) AS parts FROM ({ROWS_SQL})
      UNION ALL SELECT DISTINCT file_no, -1, -1, [CASE WHEN ios
               THEN '[14/03/24, 1:00:00 PM] Messages are end-to-end encrypted.'
               ELSE '14/03/24, 07:00 - Messages are end-to-end encrypted.' END] FROM ({ROWS_SQL})
      UNION ALL SELECT file_no, max(conv_id), 1000000, [''] FROM ({ROWS_SQL}) GROUP BY file_no),
    lines AS (SELECT file_no, conv_id, turn, unnest(parts) AS line, generate_subscripts(parts, 1) AS k FROM bodies)
    SELECT file_no, row_number() OVER (PARTITION BY file_no ORDER BY conv_id, turn, k) - 1 AS line_no,
           md5(line) AS line_md5
    FROM lines""")
def read_chat_lines(spark, folder):
    return _lines(spark, folder).select(file_no_of("file").alias("file_no"), "line_no", F.md5("line").alias("line_md5"))


@query("parse_chat_headers", f"""
    SELECT file_no, bool_or(ios) AS ios, count(*) + 1 AS n_headers, count(DISTINCT turn) AS n_clocks
    FROM ({ROWS_SQL}) GROUP BY file_no""")
def parse_chat_headers(spark, folder):
    heads = _headers(spark, folder).withColumn("head", F.coalesce("ios", "android"))
    per = heads.where(F.col("head").isNotNull()).groupBy(file_no_of("file").alias("file_no")).agg(
        F.bool_or(F.col("ios").isNotNull()).alias("ios"), F.count(F.lit(1)).alias("n_headers"),
        (F.count_distinct("head.clock") - 1).alias("n_clocks"))
    return per


@query("infer_chat_format", f"""
    SELECT DISTINCT file_no, CASE WHEN ios THEN 'ios' ELSE 'android' END AS kind, 'dmy' AS date_order,
           ios AS has_seconds, ios AS is_12h, CAST(NULL AS VARCHAR) AS problem
    FROM ({ROWS_SQL})""")
def infer_chat_format(spark, folder):
    formats = op.infer_chat_format(_headers(spark, folder))
    return formats.withColumn("file_no", file_no_of("file")).drop("file")


@query("parse_chat_ts", f"""
    SELECT conv_id, turn, epoch_us(TIMESTAMP '2024-03-14 00:00:00') // 1000000 - 5 * 3600 + CASE WHEN conv_id % 2 = 0
           THEN ((turn + 1) % 12 + 12) * 3600 + 309 ELSE (turn + 8) * 3600 + 300 END AS ts_s
    FROM ({ROWS_SQL})""")
def parse_chat_ts(spark, folder):
    n, conv = F.col("turn"), F.col("conv_id")
    clock = F.when(conv % 2 == 0, F.concat((n + 1).cast("string"), F.lit(":05:09 PM"))).otherwise(
        F.concat(F.lpad((n + 8).cast("string"), 2, "0"), F.lit(":05")))
    ts = op.parse_chat_ts(F.lit("14/03/24"), clock, F.lit("dmy"), TZ)
    return t.load_table(spark, folder, "conversations").select("conv_id", "turn", F.unix_seconds(ts).alias("ts_s"))


@query("assemble_messages", f"""
    SELECT file_no, sender, md5(body) AS body_md5,
           epoch_us(TIMESTAMP '2024-03-14 00:00:00') // 1000000 - 5 * 3600 + CASE WHEN ios
           THEN ((turn + 1) % 12 + 12) * 3600 + 309 ELSE (turn + 8) * 3600 + 300 END AS ts_s
    FROM (SELECT file_no, ios, turn, sender,
                 body || CASE WHEN lead(turn) OVER (PARTITION BY file_no ORDER BY conv_id, turn) IS NULL THEN chr(10)
                              ELSE '' END AS body FROM ({ROWS_SQL}))""")
def assemble_messages(spark, folder):
    return _messages(spark, folder).select(
        file_no_of("file").alias("file_no"), "sender", F.md5("body").alias("body_md5"), F.unix_seconds("ts").alias("ts_s"))


KIND_SQL = f"""
    SELECT file_no, conv_id, turn, sender, CASE turn % 8 WHEN 2 THEN 'omitted' WHEN 4 THEN 'deleted' WHEN 5 THEN 'other'
             WHEN 7 THEN 'other' WHEN 1 THEN 'text' WHEN 6 THEN 'text' WHEN 3 THEN 'image_missing'
             ELSE CASE WHEN conv_id % 40 % 2 = 0 THEN 'image' ELSE 'image_missing' END END AS kind,
           CASE WHEN turn % 8 IN (0, 1, 3, 6) THEN md5(trim(text, ' ' || chr(10))) END AS caption_md5
    FROM ({ROWS_SQL})"""


@query("classify_body", f"SELECT file_no, kind, caption_md5, count(*) AS n FROM ({KIND_SQL}) GROUP BY ALL")
def classify_body(spark, folder):
    return _classified(spark, folder).groupBy(
        file_no_of("file").alias("file_no"), "kind", F.md5("caption").alias("caption_md5")).agg(
        F.count(F.lit(1)).alias("n"))


@query("sender_identity", f"""
    SELECT DISTINCT sender, CASE WHEN starts_with(sender, '+') THEN replace(replace(sender, '+', ''), ' ', '')
           || '@s.whatsapp.net' ELSE 'name:' || sender END AS identity FROM ({ROWS_SQL})""")
def sender_identity(spark, folder):
    senders = _rows(spark, folder).select("sender").distinct()
    return senders.withColumn("identity", op.sender_identity(F.col("sender")))


@query("build_messages", f"""
    SELECT file_no, CASE WHEN starts_with(kind, 'image') THEN 'image' ELSE kind END AS kind,
           kind = 'image_missing' AS missing, count(*) AS n
    FROM ({KIND_SQL}) WHERE kind IN ('image', 'image_missing', 'text') GROUP BY ALL""")
def build_messages(spark, folder):
    made = op.build_messages(_classified(spark, folder), F.lit("group"))
    return made.groupBy(file_no_of("file").alias("file_no"), "kind", "missing").agg(F.count_distinct("key").alias("n"))


MEDIA_BYTES = 8000


@query("list_media", f"""
    SELECT 'page-' || page_id || '.html' AS name, octet_length(encode(html)) + 1 AS length,
           CASE WHEN octet_length(encode(html)) + 1 > {MEDIA_BYTES} THEN 'too_large' END AS reject_reason FROM pages""")
def list_media(spark, folder):
    """Every page written as a file of its own, and the folder listed: names and sizes, no content is read."""
    path = fresh_path(spark, "media")
    name = F.concat(F.lit("page-"), F.col("page_id").cast("string"), F.lit(".html"))
    pages = t.load_table(spark, folder, "pages").select(F.col("html").alias("value"), name.alias("name"))
    files.write_each(pages, "name", path)
    listed = files.list_media(spark, path, name=F.regexp_extract("path", "/name=([^/]+)/", 1))
    return files.checked_media(listed, lazy=True, max_bytes=MEDIA_BYTES).select("name", "length", "reject_reason")
