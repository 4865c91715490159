"""Joins over the stored tables and their maintenance: details, duplicates, orphans, resets, refreshes and expiry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarlens.operators import chunked
from bazaarlens.operators.screening import needs_enrichment, visible_to

# States that a reprocess takes, and lifetimes.
LOCAL_STATES = ("done", "awaiting_vlm", "failed")
TTL = "interval 24 hours"
STALE_ALBUM = "interval 7 days"
UPLOAD_SOURCE, LOCAL_OWNER = "demo_upload", "local"
# What hangs on what (parent, its key, child, the child's column), parents first; keys of tables in between.
LINKS = (("posts", "post_id", "images", "post_id"), ("posts", "post_id", "calls", "post_id"),
         ("posts", "post_id", "listings", "post_id"), ("posts", "post_id", "sightings", "post_id"),
         ("listings", "listing_id", "sightings", "listing_id"), ("listings", "listing_id", "matches", "listing_id"),
         ("wishlists", "wishlist_id", "matches", "wishlist_id"))
PRIMARY = {"listings": ["listing_id"]}


def listing_with_cover(listings: DataFrame, images: DataFrame) -> DataFrame:
    cover = images.select(F.col("image_id").alias("cover_image_id"), F.col("sha256").alias("cover_sha"))
    return listings.join(cover, "cover_image_id", "left")


def _pages(rows: DataFrame, order: list[Column], chunk: Column, payload: Column, out: str, page_size: int
           ) -> DataFrame:
    line = chunked.Line(["listing_id"], order, chunk)
    placed = chunked.row_number(rows, line, "_n").withColumn("page", F.floor((F.col("_n") - 1) / page_size))
    return placed.groupBy("listing_id", "page").agg(
        F.sort_array(F.collect_list(F.struct(F.col("_n"), payload.alias("v")))).alias("_l")).select(
        "listing_id", "page", F.transform("_l", lambda x: x["v"]).alias(out))


def listing_detail(listings: DataFrame, images: DataFrame, sightings: DataFrame, page_size: int = 1000) -> DataFrame:
    """A listing with its segment's photos and its sightings, both in order, as nested records of at most `page_size`
    entries: a listing that was seen a million times fills many pages instead of one row that no task can hold.

    Images: listing_id, image_id, seq; sightings: listing_id, seen_at, price, match_kind and a tie-break `sighting_id`."""
    shown = _pages(images, [F.col("seq")], chunked.by_rows(F.col("seq")), F.col("image_id"), "images", page_size)
    seen = _pages(sightings, [F.col("seen_at"), F.col("sighting_id")], chunked.by_days(F.col("seen_at"), 30),
                  F.struct("seen_at", "price", "match_kind"), "sightings", page_size)
    nested = shown.join(seen, ["listing_id", "page"], "full_outer")
    return listings.join(nested, "listing_id", "left").withColumn("page", F.coalesce("page", F.lit(0)))


def known_message_filter(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Messages not stored yet, by (chat_ref, msg_key)."""
    key = ["chat_ref", "msg_key"]
    return incoming.join(stored.select(*key), key, "left_anti")


def ingest_status(incoming: DataFrame, stored: DataFrame, post: list[str]) -> DataFrame:
    """Per incoming post: how many messages are new, and whether a usable photo is left (else it is a duplicate)."""
    fresh = known_message_filter(incoming, stored).groupBy(*post).agg(
        F.count(F.lit(1)).alias("n_new"), F.bool_or((F.col("kind") == "image") & ~F.col("missing")).alias("_photo"))
    every = incoming.select(*post).distinct().join(fresh, post, "left")
    return every.select(*post, F.coalesce("n_new", F.lit(0)).alias("n_new"),
                        F.when(F.coalesce("_photo", F.lit(False)), "accepted").otherwise("duplicate").alias("status"))


def unreferenced_blobs(blobs: DataFrame, images: DataFrame, wishlists: DataFrame, now: Column) -> DataFrame:
    old = blobs.where(F.col("created_at") < now - F.expr(TTL))
    return (old.join(images.select("sha256"), "sha256", "left_anti")
            .join(wishlists.select(F.col("ref_image_sha").alias("sha256")), "sha256", "left_anti"))


def media_referenced(blobs: DataFrame, images: DataFrame, posts: DataFrame, owner: str | None) -> DataFrame:
    """Blobs that a photo of a post visible to the owner shows."""
    shown = images.join(visible_to(posts, owner).select("post_id"), "post_id", "left_semi")
    return blobs.join(shown.select("sha256"), "sha256", "left_semi")


def cross_source_orphans(sightings: DataFrame, listings: DataFrame, posts: DataFrame, source: str) -> DataFrame:
    """Sightings by posts of other sources that point at listings which a reprocess of `source` would remove."""
    mine = posts.where((F.col("source") == source) & F.col("status").isin(*LOCAL_STATES)).select("post_id")
    going = listings.join(mine, "post_id", "left_semi").select("listing_id")
    other = posts.where(F.col("source") != source).select("post_id")
    return sightings.join(going, "listing_id", "left_semi").join(other, "post_id", "left_semi")


def _taken(posts: DataFrame, source: str) -> DataFrame:
    return posts.where((F.col("source") == source) & F.col("status").isin(*LOCAL_STATES))


def reprocess_counts(posts: DataFrame, listings: DataFrame, sightings: DataFrame, source: str) -> DataFrame:
    """One row: what a reprocess of the source would touch."""
    ids = _taken(posts, source).select("post_id")
    counts = [ids.agg(F.count_distinct("post_id").alias("posts")),
              listings.join(ids, "post_id", "left_semi").agg(F.count(F.lit(1)).alias("listings")),
              sightings.join(ids, "post_id", "left_semi").agg(F.count(F.lit(1)).alias("sightings"))]
    return counts[0].join(F.broadcast(counts[1])).join(F.broadcast(counts[2]))  # single rows


def reset_for_reprocess(posts: DataFrame, listings: DataFrame, sightings: DataFrame, images: DataFrame, source: str
                        ) -> dict[str, DataFrame]:
    """The four tables after a reset of one source: its sightings and listings gone, its photos' derived columns
    cleared, its posts received again. Refuses while other sources' sightings point at its listings."""
    if cross_source_orphans(sightings, listings, posts, source).limit(1).count():
        raise ValueError(f"sightings from other sources point at {source} listings; reset those too")
    ids = _taken(posts, source).select("post_id")
    flagged = images.join(ids.withColumn("_in", F.lit(True)), "post_id", "left")
    derived = [c for c in ("segment_idx", "dets", "box", "embedding", "ocr_text") if c in images.columns]
    cleared = flagged.withColumns({c: F.when(F.col("_in").isNull(), F.col(c)) for c in derived})
    again = _taken(posts, source).select("post_id", F.lit(True).alias("_in"))
    reset = posts.join(again, "post_id", "left").withColumn(
        "status", F.when(F.col("_in"), "received").otherwise(F.col("status")))
    if "outcome" in posts.columns:
        reset = reset.withColumn("outcome", F.when(F.col("_in").isNull(), F.col("outcome")))
    return {"posts": reset.drop("_in"), "listings": listings.join(ids, "post_id", "left_anti"),
            "sightings": sightings.join(ids, "post_id", "left_anti"), "images": cleared.drop("_in")}


def replace_by_source(spark: SparkSession, path: str, fresh: DataFrame, source: str) -> DataFrame:
    """Replace one source's rows of a stored table that is partitioned by source: only that source's folder is
    rewritten (dynamic overwrite). Fresh rows of other sources are left out. Returns the table."""
    (fresh.where(F.col("source") == source).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("source").parquet(path))
    return spark.read.parquet(path)


def gap_listings(listings: DataFrame, posts: DataFrame, images: DataFrame, provider: str) -> DataFrame:
    """Listings of finished posts, enriched by no model yet, that still lack fields, with what is missing."""
    open_posts = posts.where((F.col("status") == "done") & (F.col("vlm_policy") == "never")).select("post_id")
    multi = images.where(F.size("dets") > 2).select("post_id", "segment_idx").distinct().withColumn(
        "multi_item", F.lit(True))
    rows = (listings.where((F.col("extraction") == "local") & (F.col("item_idx") == 0))
            .join(open_posts, "post_id", "left_semi").join(multi, ["post_id", "segment_idx"], "left")
            .withColumn("multi_item", F.coalesce("multi_item", F.lit(False)))
            .withColumn("repost", F.lit(False)).withColumn("no_shoe", F.lit(False)))
    return needs_enrichment(rows, policy=F.lit("auto"), provider=F.lit(provider)).where("needed")


def cascade(tables: dict[str, DataFrame], gone: dict[str, DataFrame], links: tuple = LINKS) -> dict[str, DataFrame]:
    """The tables without the rows that are gone and all that hang on them. `gone`: key rows per table; links in an order
    in which a table's own losses are known before those below it. Each level is one semi join and one anti join."""
    lost = {name: keys.distinct() for name, keys in gone.items()}
    out = dict(tables)
    for parent, key, child, own in links:
        if parent not in lost or child not in out:
            continue
        keys = lost[parent].select(F.col(key).alias(own)).distinct()
        primary = PRIMARY.get(child)
        if primary:
            below = out[child].join(keys, own, "left_semi").select(*primary)
            lost[child] = below if child not in lost else lost[child].select(*primary).unionByName(below).distinct()
        out[child] = out[child].join(keys, own, "left_anti")
    return out


def ttl_purge(tables: dict[str, DataFrame], now: Column) -> dict[str, DataFrame]:
    """Survivors after uploads and session wishlists older than a day leave. Rows below a purged post, listing or wishlist
    go with it, level by level; then blobs older than a day that no photo and no wishlist refers to any more.

    tables: posts, wishlists and any of those in LINKS; blobs (sha256, created_at) if images (sha256) are there too;
    wishlists may carry ref_image_sha."""
    old = F.col("created_at") < now - F.expr(TTL)
    posts, wishlists = tables["posts"], tables["wishlists"]
    gone = {"posts": posts.where((F.col("source") == UPLOAD_SOURCE) & old).select("post_id"),
            "wishlists": wishlists.where((F.col("owner") != LOCAL_OWNER) & old).select("wishlist_id")}
    out = cascade(tables | {"posts": posts.join(gone["posts"], "post_id", "left_anti"),
                            "wishlists": wishlists.join(gone["wishlists"], "wishlist_id", "left_anti")}, gone)
    if "blobs" in out:
        held = out["images"].select("sha256")
        if "ref_image_sha" in wishlists.columns:
            held = held.unionByName(out["wishlists"].select(F.col("ref_image_sha").alias("sha256")))
        stale = out["blobs"].where(old).join(held, "sha256", "left_anti").select("sha256")
        out["blobs"] = out["blobs"].join(stale, "sha256", "left_anti")
    return out


def stale_albums(albums: DataFrame, last_arrival: Column, now: Column) -> DataFrame:
    """Adds `reject_reason`: an album ready for more than a week is not posted any more."""
    return albums.withColumn("reject_reason", F.when(last_arrival < now - F.expr(STALE_ALBUM), "stale"))
