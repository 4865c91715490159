"""Base tables and the adapter views that give them the listing data model."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bazaarlens.session import cut_lineage

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")
VOTE_BYTES = 2 << 20  # of text that is split into words at once


def load_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def dealt(df: DataFrame, key: str) -> DataFrame:
    """For work that is heavy per row: one exchange by a key, so that it does not depend on how a file is cut. Later
    groupings that hold the key need no further one."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def load_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Every base table; Spark reads only the schema until one is used."""
    return {name: load_table(spark, folder, name) for name in TABLES}


def messages(spark: SparkSession, folder: str) -> DataFrame:
    """Chat messages from the event stream; a user's events are that sender's messages."""
    e = load_table(spark, folder, "events")
    return e.select(
        F.col("event_id").alias("key"), (F.col("user_id") % 3).alias("chat"), F.col("user_id").alias("sender"),
        F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_type") == "signup", "text").otherwise("image").alias("kind"),
        F.col("event_type"), (F.col("event_type") == "error").alias("missing"),
        F.floor(F.col("value") * 100000).cast("long").alias("bytes"), F.col("value"))


def post_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Posts from conversations: a turn is a message, user and system turns are photos with a short caption."""
    c = load_table(spark, folder, "conversations")
    caption = F.when(F.length("text") % 3 == 0, None).otherwise(F.substring("text", 1, 3))
    return c.select(
        F.col("conv_id").alias("post_id"), F.col("turn").alias("seq"),
        F.when(F.col("role").isin("user", "system"), "image").otherwise("text").alias("kind"),
        caption.alias("caption"), (F.col("conv_id") * 1000 + F.col("turn")).alias("message_id"),
        (F.length("text") % 5 == 0).alias("missing"))


def listings(spark: SparkSession, folder: str, with_vector: bool = True) -> DataFrame:
    """Listings from parts; every embedding is the vector of some of them, its id the part's key modulo their number."""
    out = as_listings(load_table(spark, folder, "part"))
    return with_vectors(spark, folder, dealt(out, "listing_id"), "listing_id", "embedding") if with_vector else out


def with_vectors(spark: SparkSession, folder: str, rows: DataFrame, key: str, name: str) -> DataFrame:
    """Adds `vec_id`, the key modulo the number of embeddings, and that embedding."""
    vectors = load_table(spark, folder, "embeddings").select("vec_id", F.col("embedding").alias(name))
    number = vectors.agg(F.count(F.lit(1)).alias("_n"))  # one row
    placed = rows.join(F.broadcast(number)).withColumn("vec_id", F.col(key) % F.col("_n")).drop("_n")
    return placed.join(vectors, "vec_id")


def as_listings(parts: DataFrame) -> DataFrame:
    """The listing columns of a (batch or streaming) part table."""
    pid = F.col("p_partkey")
    size_source = F.element_at(F.array(*[F.lit(s) for s in ("caption", "vlm", "ocr", "seed")]),
                               (pid % 4 + 1).cast("int"))
    brand_source = F.element_at(F.array(*[F.lit(s) for s in ("caption", "siglip", "ocr", "knn", "vlm")]),
                                (pid % 5 + 1).cast("int"))
    return parts.select(
        pid.alias("listing_id"), (pid * 10).alias("post_id"), F.lit(0).alias("segment_idx"),
        F.col("p_brand").alias("brand"), F.col("p_name").alias("model"),
        F.when(pid % 7 != 0, F.col("p_size").cast("decimal(4,1)")).alias("size_eu"),
        size_source.alias("size_source"), brand_source.alias("brand_source"),
        F.when(pid % 11 != 0, F.col("p_retailprice").cast("int")).alias("price"),
        F.when(pid % 17 == 0, "USD").when(pid % 17 < 9, "PKR").alias("currency"),
        F.when(pid % 13 == 0, "sold").otherwise("active").alias("status"),
        (pid % 100).alias("seller"),
        F.when(pid % 5 == 0, "demo_seed").when(pid % 5 == 1, "demo_upload").otherwise("chat_export").alias("source"),
        F.when(pid % 5 == 1, F.concat(F.lit("u"), (pid % 4).cast("string"))).alias("owner_session"),
        (pid % 4).alias("repost_count"),
        F.timestamp_seconds(F.lit(1704067200) + pid * 7919 % 7776000).alias("last_seen"))


def sightings(spark: SparkSession, folder: str) -> DataFrame:
    """Listing sightings from line items."""
    li = load_table(spark, folder, "lineitem")
    return li.select(
        F.col("l_partkey").alias("listing_id"), F.col("l_orderkey").alias("post_id"),
        F.col("l_linenumber").alias("segment_idx"), F.col("l_shipdate").cast("timestamp").alias("seen_at"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").cast("int").alias("qty"),
        F.when(F.col("l_returnflag") == "A", "origin").when(F.col("l_returnflag") == "N", "phash")
        .otherwise("embedding").alias("match_kind"), F.col("l_suppkey").alias("suppkey"))


def wishlists(spark: SparkSession, folder: str, with_vector: bool = True) -> DataFrame:
    """Standing queries from customers."""
    c = load_table(spark, folder, "customer")
    cid = F.col("c_custkey")
    size = (cid % 50 + 1).cast("decimal(4,1)")
    out = c.select(
        cid.alias("wishlist_id"),
        F.when(cid % 5 == 0, "local").otherwise(F.concat(F.lit("u"), (cid % 4).cast("string"))).alias("owner"),
        F.when(cid % 3 != 0, F.concat(F.lit("Brand#"), (cid % 25 + 1).cast("string"))).alias("brand"),
        F.when(cid % 4 != 0, size).alias("size_min"), F.when(cid % 4 != 0, size).alias("size_max"),
        F.when(cid % 6 != 0, 950).alias("max_price"), F.lit(0.2).alias("min_score"),
        (cid % 10 != 9).alias("active"))
    return with_vectors(spark, folder, dealt(out, "wishlist_id"), "wishlist_id", "query_vec") if with_vector else out


def calls(spark: SparkSession, folder: str) -> DataFrame:
    """An enrichment ledger from events: one row per call. A segment's calls fall on one day."""
    e = load_table(spark, folder, "events")
    status = (F.when(F.col("event_type") == "view", "ok").when(F.col("event_type") == "click", "bad_json")
              .when(F.col("event_type") == "purchase", "timeout").when(F.col("event_type") == "signup", "reserved")
              .otherwise("http_error"))
    return e.select(
        F.col("event_id").alias("call_id"), F.col("user_id").alias("post_id"),
        F.dayofyear("ts").alias("segment_idx"), F.concat(F.lit("v"), (F.col("user_id") % 2).cast("string"))
        .alias("prompt_version"), F.col("ts").cast("timestamp").alias("ts"), F.to_date("ts").alias("day"), status.alias("status"),
        F.round(F.col("value") / 1000, 6).alias("cost"), F.col("value"), F.col("props"),
        F.concat(F.lit("model-"), (F.col("user_id") % 3).cast("string")).alias("model"))


def beats(spark: SparkSession, folder: str) -> DataFrame:
    """Heartbeats from events: every user is a source."""
    e = load_table(spark, folder, "events")
    state = (F.when(F.col("event_type") == "signup", "open").when(F.col("event_type") == "error", "logged_out")
             .when(F.col("event_type") == "click", "replaced").otherwise("connecting"))
    return e.select(
        F.col("user_id").alias("source"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("beat_id"), state.alias("state"),
        F.when(F.col("value") < 5, "shutdown").alias("detail"),
        F.when(F.col("value") > 50, F.col("ts").cast("timestamp")).alias("last_message_at"))


def texts(spark: SparkSession, folder: str) -> DataFrame:
    """Every text of the corpus: documents, page sources and conversation turns."""
    d = dealt(load_table(spark, folder, "documents").select("doc_id", "text"), "doc_id").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.col("text"))
    p = load_table(spark, folder, "pages").select(
        F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("id"), F.col("html").alias("text"))
    c = load_table(spark, folder, "conversations").select(
        F.concat_ws("-", F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.col("turn").cast("string"))
        .alias("id"), F.col("text"))
    return d.unionByName(p).unionByName(c)


def _votes(texts: pa.Array) -> pa.Array:
    """For every text the votes of its words on 64 bits. Words are hashed once per slice of texts."""
    sizes, start, cast = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)), 0, [np.empty((0, 64), np.int32)]
    while start < len(texts):
        before = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, before + VOTE_BYTES, side="right")))
        words = pc.split_pattern(texts.slice(start, end - start), " ")
        named = words.flatten().dictionary_encode()
        hashed = [hashlib.md5(w).digest()[:8] for w in named.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False)]
        halves = np.frombuffer(b"".join(hashed), ">u4").astype("<u4").view(np.uint8).reshape(-1, 8)
        signs = np.unpackbits(halves, axis=1, bitorder="little").view(np.int8) * np.int8(2) - np.int8(1)
        every = signs[named.indices.to_numpy(zero_copy_only=False)]
        ends = np.cumsum(pc.list_value_length(words).to_numpy(zero_copy_only=False))  # a text has a word, if an empty one
        cast.append(np.stack([every[a:b].sum(axis=0, dtype=np.int32) for a, b in zip([0, *ends[:-1]], ends)]))
        start = end
    votes = np.concatenate(cast)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, votes.size + 1, 64, dtype=np.int32)), pa.array(votes.ravel()))


def simhash(df: DataFrame, id_cols: list[str], text_col: str) -> DataFrame:
    """A 64-bit fingerprint per text: every word votes with the bits of its md5 halves; the sign of a bit's vote sets
    it. A text's words are counted where it lies, and only its 64 sums are kept; rows of one id add up."""
    votes = F.arrow_udf(_votes, T.ArrayType(T.IntegerType()))
    known = df.select(*id_cols, F.lower(F.col(text_col)).alias("_text")).where("_text is not null").select(
        *id_cols, votes(F.col("_text")).alias("_votes"))
    sums = [F.sum(F.col("_votes")[bit]).alias(f"b{bit // 32}_{bit % 32}") for bit in range(64)]
    summed = known.groupBy(*id_cols).agg(*sums)

    def packed(half: int) -> Column:
        total = F.lit(0).cast("long")
        for bit in range(32):
            total = total + F.when(F.col(f"b{half}_{bit}") > 0, F.lit(1 << bit)).otherwise(F.lit(0)).cast("long")
        return total

    return summed.select(*id_cols, F.shiftleft(packed(0), 32).bitwiseOR(packed(1)).alias("phash"))


def doc_images(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as photos: each document is a post of one photo whose hash is the text's fingerprint, and a listing of
    its own; copies are not folded.

    The fingerprints are written once to the shared folder: callers read them many times, the texts only here."""
    docs = load_table(spark, folder, "documents").select("doc_id", "text", "source")
    hashed = cut_lineage(simhash(docs, ["doc_id", "source"], "text"))
    return hashed.select(F.col("doc_id").alias("post_id"), "phash", F.col("doc_id").alias("listing_id"),
                         F.col("source").alias("seller"))


def first_rows(df: DataFrame, keys: list[str], order: list[Column], n: int, out: str = "rn") -> DataFrame:
    """The first n rows per key. Spark turns the filter into a per-task group limit ahead of the shuffle, so a hot
    key ships at most n rows per task."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(out) <= n)


def images(spark: SparkSession, folder: str) -> DataFrame:
    """Photos with detections from the event stream: a user is a post, a day a segment, 0 to 4 boxes a photo."""
    e = dealt(load_table(spark, folder, "events").select("event_id", "user_id", "ts", "value"), "event_id")
    eid = F.col("event_id")

    def det(i: Column) -> Column:
        x1, y1 = F.floor("value") + i * 20, eid % 50 + i * 10
        corners = (x1, y1, x1 + 60 + (eid + i) % 9 * 7, y1 + 40 + (eid * 3 + i) % 7 * 5)
        return F.struct(F.array(*[c.cast("double") for c in corners]).alias("box"),
                        ((eid * 7 + i * 31) % 100 / 100).alias("conf"), F.lit("shoe").alias("cls"))

    count = (eid % 5).cast("int")
    dets = F.transform(F.slice(F.array(*[F.lit(i) for i in range(4)]), F.lit(1), count), lambda i: det(i))
    return e.select(
        eid.alias("image_id"), F.col("user_id").alias("post_id"), F.dayofyear("ts").alias("segment_idx"),
        eid.alias("seq"), F.lit(640).alias("width"), F.lit(480).alias("height"), dets.alias("dets"),
        F.when(eid % 6 == 1, (eid % 10 + 36).cast("decimal(4,1)")).alias("tag_size"),
        F.when(eid % 5 == 2, F.concat(F.lit("Brand#"), (eid % 25 + 1).cast("string"))).alias("tag_brand"))
