"""Streaming jobs: sources, dedupe, late drop, matching and repost resolution per micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bazaarlens.functions.ids import hamming64
from bazaarlens.operators import cells, chunked, hashes, matching, reposts
from bazaarlens.session import cut_lineage, fresh_path
from bazaarlens.sources.store import BucketTable
from bazaarlens.streaming import albums


NO_DATA = "spark.sql.streaming.noDataMicroBatches.enabled"


def message_stream(spark: SparkSession, folder: str, table: str, schema: T.StructType, files_per_trigger: int = 64
                   ) -> DataFrame:
    """A file stream over one table of a folder, whether it is a single file or a folder of files."""
    path = f"{folder.rstrip('/')}/{table}.parquet"
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if spark.read.format("binaryFile").load(path).select("path").limit(1).first()["path"].endswith(f"/{table}.parquet"):
        return reader.option("pathGlobFilter", f"{table}.parquet").parquet(folder)
    return reader.parquet(path)


def run_to_end(spark: SparkSession, stream: DataFrame, name: str, partition_by: list[str] | None = None) -> str:
    """Process all that is available into a parquet table; returns its path. Exactly once by sink log and checkpoint."""
    out = fresh_path(spark, name)
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", out).option(
        "checkpointLocation", fresh_path(spark, name + "-state")).trigger(availableNow=True)
    (writer.partitionBy(*partition_by) if partition_by else writer).start().awaitTermination()
    return out


def run_albums(spark: SparkSession, messages: DataFrame, shards: int, name: str = "albums", **options) -> str:
    """Process all messages, then shut down: markers flush every shard in a second run from the same checkpoint.
    Returns the path of a table with the partitions record=album and record=late."""
    out, state, control = (fresh_path(spark, name + x) for x in ("", "-state", "-control"))
    albums.flush_markers(spark, shards).limit(0).write.parquet(control)
    rows = messages.unionByName(spark.readStream.schema(albums.MARKERS).parquet(control))
    stream = albums.stream_albums(rows, shards=shards, **options)
    idle_batches = spark.conf.get(NO_DATA)
    for _ in range(2):
        spark.conf.set(NO_DATA, "false")  # timers by the clock ask for batches for ever; a replay ends with its data
        try:
            query = (stream.writeStream.format("parquet").outputMode("append").option("path", out).partitionBy("record")
                     .option("checkpointLocation", state).trigger(availableNow=True).start())
        finally:
            spark.conf.set(NO_DATA, idle_batches)
        query.awaitTermination()
        albums.flush_markers(spark, shards).write.mode("append").parquet(control)
    return out


def run_batches(spark: SparkSession, stream: DataFrame, handle: Callable[[DataFrame, int], None], name: str) -> None:
    (stream.writeStream.foreachBatch(handle).option("checkpointLocation", fresh_path(spark, name + "-state"))
     .trigger(availableNow=True).start().awaitTermination())


def stream_dedupe(messages: DataFrame, key: str, within: str) -> DataFrame:
    """Messages whose key was not seen within the time bound. State is dropped as the watermark passes, so the memory
    is bounded by time instead of by a count of keys."""
    return messages.withWatermark("ts", within).dropDuplicatesWithinWatermark([key])


def mark_late(messages: DataFrame, now, max_backlog: str) -> DataFrame:
    """Adds `verdict`: kept or too_old. Late rows go to a table of their own with the reason, not into a void."""
    late = F.col("ts").isNull() | (F.col("ts") < now - F.expr(f"interval {max_backlog}"))
    return messages.withColumn("verdict", F.when(late, "too_old").otherwise("kept"))


def match_batch(wishlists: DataFrame, ledger: BucketTable) -> Callable[[DataFrame, int], None]:
    """Match each batch of new or changed listings; a pair that is stored stays as it is, so a replayed batch or a
    changed price adds nothing twice. Wishlists are placed in their cells once; a batch reads only the ledger buckets of
    its listings and rewrites none.

    A wishlist and a listing that come once meet once, so matches of listings that are new to the ledger go there as they
    leave the join. Only those of listings or wishlists that come again are compared with what is stored."""
    placed = cut_lineage(matching.wishlist_rows(wishlists))
    repeated = cut_lineage(wishlists.groupBy("wishlist_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    if repeated.isEmpty():
        once, twice = placed, None
    else:
        once, twice = (_by_id(placed, repeated, "wishlist_id", how) for how in ("left_anti", "left_semi"))

    def handle(batch: DataFrame, _: int) -> None:
        known = ledger.read(ledger.touched(batch))
        ids = batch.groupBy("listing_id").agg(F.count(F.lit(1)).alias("n"))
        stored = _by_id(ids, known.select("listing_id"), "listing_id", "left_semi")
        again = cut_lineage(ids.where("n > 1").unionByName(stored).select("listing_id").distinct())
        some = not again.isEmpty()
        fresh = _by_id(batch, again, "listing_id", "left_anti") if some else batch
        found = matching.match_wishlists(once, fresh, placed=True)
        others = [matching.match_wishlists(w, rows, placed=True) for w, rows in (
            (once, _by_id(batch, again, "listing_id", "left_semi") if some else None), (twice, batch)) if w is not None and rows is not None]
        if others:
            others = others[0].unionByName(others[1]) if len(others) > 1 else others[0]
            found = found.unionByName(matching.new_matches_only(others, known))
        ledger.append(found, spread=True)
    return handle


def _by_id(rows: DataFrame, ids: DataFrame, key: str, how: str) -> DataFrame:
    """Rows whose key is (left_semi) or is not (left_anti) among the ids; null is a key like any other."""
    return rows.join(ids.select(F.col(key).alias("_id")), F.col(key).eqNullSafe(F.col("_id")), how)


MATCHES = "wishlist_id long, listing_id long, score double"
LISTINGS = "listing_id long, seller string, owner string, last_seen timestamp, embedding array<double>"
PHOTOS = "phash long, listing_id long, post_id long, choice int, band long"
SIGHTINGS = "post_id long, segment_idx int, listing_id long, kind string, seen_at timestamp"


class RepostState:
    """What live resolution knows: a listing's seller, owner, vector and the time it was last seen, and the photos of all
    its sightings, filed by the bands of their hashes."""

    def __init__(self, spark: SparkSession, distance: int = reposts.MAX_DISTANCE):
        self.distance = distance
        self.listings = BucketTable.new(spark, "listings", LISTINGS, ["listing_id"])
        self.photos = BucketTable.new(spark, "photos", PHOTOS, ["choice", "band"])
        self.sightings = BucketTable.new(spark, "sightings", SIGHTINGS, ["post_id"])


def near_known(new: DataFrame, state: RepostState) -> DataFrame:
    """(post_id, segment_idx, seq, listing_id, distance) of a batch's photos and the stored listings with a near one.
    Only the buckets that the batch's bands fall into are read."""
    banded = cut_lineage(hashes.banded(new.select("post_id", "segment_idx", "seq", F.col("phash").alias("a")), "a", state.distance))
    stored = state.photos.read(state.photos.touched(banded)).select(
        "choice", "band", F.col("phash").alias("b"), "listing_id", F.col("post_id").alias("other"))
    near = hamming64(F.col("a"), F.col("b"))
    met = banded.join(stored, ["choice", "band"]).where((near <= state.distance) & (F.col("other") != F.col("post_id")))
    return met.groupBy("post_id", "segment_idx", "seq", "listing_id").agg(F.min(near).alias("distance"))


def resolve_batch(new: DataFrame, state: RepostState, *, max_distance: int = reposts.MAX_DISTANCE,
                  cross_distance: int = reposts.CROSS_DISTANCE, window_days: int = reposts.WINDOW_DAYS,
                  min_cosine: float = reposts.MIN_COSINE) -> DataFrame:
    """(post_id, segment_idx, listing_id, kind) for a batch, as if its posts were taken one by one after what is stored,
    in post order: by hash, else by vector, else a new listing whose id is the post's.

    `new`: a row per photo with post_id, segment_idx, seq, phash, seller, owner, ref_time, embedding (the segment's).
    A repost's photos join its listing, and its time moves the listing's last_seen for the posts after it. Everything
    near anything is found once, stored side and batch; then every round judges all posts under the labels of the
    round before. A post's label is final once those it rests on are, so the rounds follow the longest chain of reposts
    that rest on each other, and end when nothing changes."""
    segment = ["post_id", "segment_idx"]
    window = F.make_dt_interval(F.lit(window_days))
    posts = cut_lineage(new.groupBy(*segment).agg(
        F.min("seller").alias("seller"), F.min("owner").alias("owner"), F.max("ref_time").alias("ref_time"),
        F.first("embedding").alias("embedding"), F.count(F.lit(1)).alias("total")))
    photos = new.select(*segment, "seq", "phash")
    other = photos.select(F.col("phash").alias("b"), F.col("post_id").alias("o_post"), F.col("segment_idx").alias("o_segment"))
    here = (photos.join(hashes.hash_pairs(photos, photos, state.distance), F.col("phash") == F.col("a"))
            .join(other, "b").where(F.col("o_post") < F.col("post_id"))
            .groupBy(*segment, "seq", "o_post", "o_segment").agg(F.min("distance").alias("distance")))
    here, stored = cut_lineage(here), cut_lineage(near_known(new, state))
    ids = stored.select("listing_id").distinct()
    vectors = posts.where("embedding is not null").select(*segment, "seller", "embedding")
    reach = cells.reach_of(min_cosine)
    like = cut_lineage(reposts.alike(vectors, vectors.select(
        F.col("post_id").alias("o_post"), F.col("segment_idx").alias("o_segment"), "seller", "embedding"), reach, min_cosine)
        .where(F.col("o_post") < F.col("post_id")))
    known = state.listings.read().join(posts.select("seller").distinct(), "seller", "left_semi")
    like_known = cut_lineage(reposts.alike(vectors, known.where("embedding is not null").select(
        F.col("listing_id").alias("o_post"), F.lit(-1).alias("o_segment"), "seller", "embedding"), reach, min_cosine)
        .where(F.col("o_post") != F.col("post_id")))
    base = state.listings.read().select("listing_id", F.col("seller").alias("l_seller"), F.col("owner").alias("l_owner"),
                                        F.col("last_seen").alias("l_seen"))
    wanted = ids.unionByName(like_known.select(F.col("o_post").alias("listing_id"))).distinct()
    base = cut_lineage(base.join(wanted, "listing_id", "left_semi"))
    labels = cut_lineage(posts.select(*segment, F.col("post_id").alias("listing_id"), F.lit("new").alias("kind")))
    while True:
        # what the listings are, heads of the batch included, and when they were seen by which post
        heads = labels.where("kind = 'new'").join(posts, segment).select(
            "listing_id", F.col("seller").alias("l_seller"), F.col("owner").alias("l_owner"), F.lit(None).cast("timestamp").alias("l_seen"))
        listed = base.unionByName(heads.dropDuplicates(["listing_id"]))
        labelled = labels.select(F.col("post_id").alias("o_post"), F.col("segment_idx").alias("o_segment"), "listing_id")
        hits = here.join(labelled, ["o_post", "o_segment"]).select(*segment, "seq", "listing_id", "distance").unionByName(
            stored.select(*segment, "seq", "listing_id", "distance"))
        close = like.join(labels.where("kind = 'new'").select(F.col("post_id").alias("o_post"), F.col("segment_idx").alias("o_segment"),
                                                              "listing_id"), ["o_post", "o_segment"]).select(
            *segment, "listing_id", "cos").unionByName(like_known.select(*segment, F.col("o_post").alias("listing_id"), "cos"))
        pairs = hits.select(*segment, "listing_id").unionByName(close.select(*segment, "listing_id")).distinct()
        # the listing's last_seen just before the post: stored, and the highest time of its sightings by earlier posts
        seen = labels.join(posts.select(*segment, "ref_time"), segment).select(
            "listing_id", "post_id", "segment_idx", F.col("ref_time").alias("_t"))
        asked = pairs.select("listing_id", *segment, F.lit(None).cast("timestamp").alias("_t"), F.lit(True).alias("_asks"))
        timeline = seen.withColumn("_asks", F.lit(False)).unionByName(asked)
        line = chunked.Line(["listing_id"], [F.col("post_id"), F.col("_asks").cast("int").desc(), F.col("segment_idx")],
                            chunked.by_rows(F.col("post_id")))
        before = chunked.prefix_max(timeline, line, F.col("_t"), "_before").where("_asks").select("listing_id", *segment, "_before")
        allowed = pairs.join(before, ["listing_id", *segment]).join(listed, "listing_id").join(
            posts.select(*segment, "seller", "owner", "ref_time", "total"), segment)
        allowed = cut_lineage(allowed.where(F.greatest("l_seen", "_before") > F.col("ref_time") - window))
        by_hash = hits.join(allowed, [*segment, "listing_id"]).where(
            F.col("owner").eqNullSafe(F.col("l_owner"))
            & (F.col("distance") <= F.when(F.col("l_seller") == F.col("seller"), F.lit(max_distance)).otherwise(F.lit(cross_distance))))
        matched = by_hash.groupBy(*segment, "listing_id").agg(F.count_distinct("seq").alias("matched"), F.first("total").alias("total"))
        best = matched.groupBy(*segment).agg(F.max(F.struct("matched", (-F.col("listing_id")).alias("neg"), "total")).alias("b"))
        best = best.where(F.col("b.matched") >= F.ceil(F.col("b.total") / 2)).select(*segment, (-F.col("b.neg")).alias("_hash"))
        near = close.join(allowed.select(*segment, "listing_id", "l_seller", "seller"), [*segment, "listing_id"]).where(
            F.col("l_seller") == F.col("seller")).groupBy(*segment).agg(
            F.max(F.struct("cos", (-F.col("listing_id")).alias("neg"))).alias("c")).select(*segment, (-F.col("c.neg")).alias("_near"))
        fresh = posts.select(*segment).join(best, segment, "left").join(near, segment, "left").select(
            *segment, F.coalesce("_hash", "_near", "post_id").alias("listing_id"),
            F.when(F.col("_hash").isNotNull(), "phash").when(F.col("_near").isNotNull(), "embedding").otherwise("new").alias("kind"))
        fresh = cut_lineage(fresh)
        old = labels.select(*segment, F.col("listing_id").alias("_old"), F.col("kind").alias("_old_kind"))
        changed = fresh.join(old, segment).where("listing_id != _old or kind != _old_kind").limit(1).count()
        labels = fresh
        if not changed:
            return labels


def repost_batch(state: RepostState, photos: Callable[[DataFrame], DataFrame], **rules) -> Callable[[DataFrame, int], None]:
    """Resolve each batch against everything stored, then store its sightings, photos and listings. A replayed batch
    finds its own posts among the sightings and adds nothing."""
    def handle(batch: DataFrame, _: int) -> None:
        arrived = cut_lineage(photos(batch))
        done = state.sightings.read(state.sightings.touched(arrived)).select("post_id").distinct()
        new = arrived if done.isEmpty() else cut_lineage(arrived.join(done, "post_id", "left_anti"))
        labels = cut_lineage(resolve_batch(new, state, **rules))
        facts = cut_lineage(new.join(labels, ["post_id", "segment_idx"]))
        state.photos.append(cut_lineage(hashes.banded(facts.select("post_id", "listing_id", "phash"), "phash", state.distance)))
        seen = facts.groupBy("listing_id").agg(
            F.max("ref_time").alias("_at"),
            *[F.min_by(c, F.when(F.col("kind") == "new", F.struct("post_id", "segment_idx"))).alias(f"_{c}")
              for c in ("seller", "owner", "embedding")])
        old = state.listings.read(state.listings.touched(seen))
        merged = seen.join(old, "listing_id", "left").select(
            "listing_id", F.coalesce("seller", "_seller").alias("seller"), F.coalesce("owner", "_owner").alias("owner"),
            F.greatest("last_seen", "_at").alias("last_seen"), F.coalesce("embedding", "_embedding").alias("embedding"))
        state.listings.upsert(cut_lineage(merged), ["listing_id"], [F.col("last_seen")])
        state.sightings.append(facts.groupBy("post_id", "segment_idx", "listing_id", "kind").agg(F.max("ref_time").alias("seen_at")))
    return handle
