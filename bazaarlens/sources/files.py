"""File sources: chat-export text, media folders, post manifests and attribution tables."""

from __future__ import annotations

import os
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bazaarlens.operators import chunked
from bazaarlens.operators.screening import MAX_FILE_BYTES, media_verdict
from bazaarlens.sources.tables import dealt

# Marks that chat exports put around text, spaces that stand for a plain one, the attribution header and
# the slug form.
BIDI_MARKS = "[﻿‎‏‪-‮⁦-⁩]"
ODD_SPACES = "  "
ATTRIBUTION = ("file", "sha256", "source_url", "author", "license", "license_url", "notes")
SLUG = r"^[a-z0-9][a-z0-9-]{1,60}$"
SHARDS = 64
NOT_IN_FOLDERS = {*map(chr, range(1, 32)), *"\"#%'*/:=?\\\x7f{[]^"}

MANIFEST = T.StructType([
    T.StructField("version", T.IntegerType()),
    T.StructField("posts", T.ArrayType(T.StructType([
        T.StructField("slug", T.StringType()), T.StructField("seller", T.StringType()),
        T.StructField("caption", T.StringType()), T.StructField("days_ago", T.DoubleType()),
        T.StructField("images", T.ArrayType(T.StringType())),
        T.StructField("attrs", T.StructType([
            T.StructField("brand", T.StringType()), T.StructField("model", T.StringType()),
            T.StructField("colour", T.StringType()), T.StructField("size_label", T.StringType()),
            T.StructField("size_eu", T.DoubleType()), T.StructField("price", T.LongType()),
            T.StructField("currency", T.StringType()), T.StructField("condition", T.StringType())]))]))),
])


def clean_line(line: Column) -> Column:
    plain = F.regexp_replace(line, BIDI_MARKS, "")
    return F.regexp_replace(F.translate(plain, ODD_SPACES, " " * len(ODD_SPACES)), r"[\r\n]+$", "")


def read_chat_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of chat-export files as (file, line_no, line), numbered from 0.

    Files are split like any text, so a large one is read by many tasks. A line's place is (split start, position in
    the split), and numbers are counted per split and carried, so no file passes through one task. A file that ends in
    a newline has one more, empty, line."""
    raw = spark.read.option("lineSep", "\n").text(path)
    placed = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("_size"),
                        F.col("_metadata.file_block_start").alias("_split"),
                        F.monotonically_increasing_id().alias("_pos"), "value")
    line = chunked.Line(["file"], [F.col("_split"), F.col("_pos")], F.col("_split"))
    numbered = chunked.row_number(placed, line, "_n")
    ends = placed.groupBy("file").agg(
        F.count(F.lit(1)).alias("line_no"), F.max("_size").alias("_size"),
        F.sum(F.octet_length("value") + 1).alias("_bytes"))
    # a byte order mark counts in the size and not in the lines
    tail = ends.where(F.col("_bytes").isin(F.col("_size"), F.col("_size") - 3)).select(
        "file", "line_no", F.lit("").alias("line"))
    return numbered.select("file", (F.col("_n") - 1).alias("line_no"), clean_line(F.col("value")).alias("line")
                           ).unionByName(tail)


def write_each(rows: DataFrame, name: str, path: str, shards: int = SHARDS) -> None:
    """The text in `value` of every `name` as a file in a folder name=... of its own.

    The folders lie in shards, so that a listing is a task per shard and not one per file. Where the shared folder is one of
    the machine's file system, tasks write the files there themselves: Spark's writer starts a process per file to set its
    mode, and moves every file into place. Elsewhere Spark writes, and tasks move their files. The path must be new: a run
    that fails leaves what was written."""
    placed = rows.withColumn("shard", F.pmod(F.xxhash64(name), F.lit(shards)).cast("int"))
    local = _local(rows.sparkSession, path)
    if local is None:
        (dealt(placed, name).write.option("mapreduce.fileoutputcommitter.algorithm.version", "2")
         .partitionBy("shard", name).text(path))
        return
    ordered = dealt(placed.select("shard", F.col(name).cast("string").alias("name"), "value"), "name").sortWithinPartitions("shard", "name")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        written, file, at = 0, None, None
        try:
            for batch in batches:
                for shard, own, value in zip(*(batch.column(c).to_pylist() for c in range(3))):
                    if file is None or own != at:
                        if file is not None:
                            file.close()
                        folder = f"{local}/shard={shard}/{name}={_escaped(own)}"
                        os.makedirs(folder, exist_ok=True)
                        file, at = open(f"{folder}/part.txt", "wb"), own  # a task that is tried again writes the same
                        written += 1
                    file.write((value or "").encode() + b"\n")
        finally:
            if file is not None:
                file.close()
        yield pa.RecordBatch.from_pydict({"n": pa.array([written], pa.int64())})

    ordered.mapInArrow(write, "n long").agg(F.sum("n")).collect()  # one row


def _escaped(value: str | None) -> str:
    """A partition value as Spark names its folder."""
    if not value:
        return "__HIVE_DEFAULT_PARTITION__"
    return "".join(f"%{ord(c):02X}" if c in NOT_IN_FOLDERS else c for c in value)


def _local(spark: SparkSession, path: str) -> str | None:
    """The path in the machine's file system if Spark's readers find it there, or none."""
    probe = f"{path}/_where"  # a name that no listing shows
    spark.range(1).select(F.lit("").alias("value")).write.text(probe)
    found = urlparse(spark.read.text(probe).select("_metadata.file_path").first()[0])
    return unquote(found.path).rsplit("/_where/", 1)[0] if found.scheme == "file" and found.netloc == "" else None


def list_media(spark: SparkSession, path: str, glob: str | None = None, name: Column | None = None) -> DataFrame:
    """Name, path, size of every file below a folder. Content is not read unless a later step asks for it. The name is the
    file's own, or what `name` makes of the path."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    own = F.element_at(F.split("path", "/"), -1)
    files = files.select("path", "length", "modificationTime", "content").where(~own.startswith(".") & ~own.startswith("_"))
    return files.withColumn("name", own if name is None else name)


def checked_media(files: DataFrame, lazy: bool = False, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """Adds `reject_reason`; lazy checks sizes only and so never reads content."""
    if lazy:
        return files.withColumn("reject_reason", F.when(F.col("length") > max_bytes, "too_large"))
    return files.withColumn("reject_reason", media_verdict(F.col("content"), F.col("length"), max_bytes))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Posts of a manifest file, one row each, with `problems`; a slug used twice is one of them."""
    return _checked_posts(spark.read.schema(MANIFEST).option("multiLine", True).json(path))


def read_manifest_lines(spark: SparkSession, path: str) -> DataFrame:
    """The same for many manifests, one JSON document per line, which splits across tasks."""
    return _checked_posts(spark.read.schema(MANIFEST).json(path))


def _checked_posts(documents: DataFrame) -> DataFrame:
    posts = documents.select("version", F.inline("posts"))
    uses = posts.groupBy("slug").agg(F.count(F.lit(1)).alias("_uses"))
    checks = {
        "bad_slug": ~F.coalesce(F.col("slug").rlike(SLUG), F.lit(False)),
        "duplicate_slug": F.col("_uses") > 1,
        "caption_too_long": F.coalesce(F.length("caption") > 500, F.lit(False)),
        "days_ago_out_of_range": ~F.coalesce(F.col("days_ago"), F.lit(0.0)).between(0, 60),
        "images_not_1_to_4": ~F.coalesce(F.size("images").between(1, 4), F.lit(False)),
    }
    named = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in checks.items()]))
    return posts.join(uses, "slug").withColumn("problems", named).drop("_uses")


def read_attribution(spark: SparkSession, path: str) -> DataFrame:
    """The attribution table; a header other than the fixed one is refused by the reader."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ATTRIBUTION])
    return (spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("multiLine", True)
            .csv(path))
