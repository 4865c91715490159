"""Wishlists against listings, search, neighbours and labels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarlens.functions import captions
from bazaarlens.functions.vectors import cosine
from bazaarlens.operators import blocks, cells, screening
from bazaarlens.session import cut_lineage
from bazaarlens.sources.tables import first_rows

# Neighbour and label thresholds, and limits of the outbox and of wishlists.
TRUSTED_BRAND_SOURCES = ("caption", "ocr", "vlm", "seed")
NEIGHBOURS, MIN_VOTES, MIN_NEIGHBOUR_COS = 5, 3, 0.92
LABEL_FLOOR, LABEL_MARGIN = 0.08, 0.03
MAX_ACTIVE_WISHLISTS = 10
TOP_MATCHES = 100
OUTBOX_LIMIT, OUTBOX_ATTEMPTS = 50, 3
FIRST_WAVE = 4  # times k: rows a search looks at before it bounds the rest
ANY, UNKNOWN = "*", "?"
ALL, SEED = "*", "seed"  # what a wishlist sees: all listings, or seeds and those of its own session
CELL = ["brand_cell", "size_cell", "sight"]
STRIPE_SCORES = 1 << 22  # scores of a block that are held at once


def _wishlist_cells(wishlists: DataFrame) -> DataFrame:
    """The cells a wishlist looks into: its brand family or any, each whole size its range can reach (with the slack for
    model-read sizes) plus unknown, or any, and whose listings it sees."""
    low = F.floor(F.col("size_min") - screening.SIZE_SLACK).cast("long")
    high = F.floor(F.col("size_max") + screening.SIZE_SLACK).cast("long")
    reach = F.transform(F.sequence(low, high), lambda s: s.cast("string"))
    known = F.coalesce(reach, F.array().cast("array<string>"))  # without an upper end only unknown sizes fit
    sizes = F.when(F.col("size_min").isNull(), F.array(F.lit(ANY))).otherwise(F.concat(known, F.array(F.lit(UNKNOWN))))
    own = F.array_compact(F.array(F.lit(SEED), F.concat(F.lit("="), "owner")))
    return (wishlists.withColumn("brand_cell", F.coalesce(captions.brand_family(F.col("brand")), F.lit(ANY)))
            .withColumn("size_cell", F.explode(sizes))
            .withColumn("sight", F.explode(F.when(F.col("owner") == "local", F.array(F.lit(ALL))).otherwise(own))))


def _listing_cells(listings: DataFrame) -> DataFrame:
    """The cells a listing is found in: (its brand family, any) x (its whole size or unknown, any) x (seed or its session,
    all)."""
    family = captions.brand_family(F.col("brand"))
    brands = F.array_compact(F.array(family, F.lit(ANY)))
    size = F.coalesce(F.floor("size_eu").cast("string"), F.lit(UNKNOWN))
    session = F.concat(F.lit("="), F.coalesce("owner_session", F.lit("")))
    shown = F.when(F.col("source") == screening.SEED_SOURCE, F.lit(SEED)).otherwise(session)
    return (listings.withColumn("brand_cell", F.explode(brands))
            .withColumn("size_cell", F.explode(F.array(size, F.lit(ANY))))
            .withColumn("sight", F.explode(F.array(shown, F.lit(ALL)))))


def wishlist_rows(wishlists: DataFrame) -> DataFrame:
    """Active wishlists in the cells they look into, as `match_wishlists` reads them."""
    return _wishlist_cells(wishlists.where("active")).select(
        *CELL, "wishlist_id", F.col("size_min").cast("double").alias("size_min"),
        F.col("size_max").cast("double").alias("size_max"), F.col("max_price").cast("double").alias("max_price"),
        "min_score", "query_vec")


def match_wishlists(wishlists: DataFrame, listings: DataFrame, placed: bool = False) -> DataFrame:
    """All (wishlist_id, listing_id, score) that pass the wishlist's filters, visibility and score gate.

    A wishlist and a listing meet in at most one (brand, size, sight) cell, so most filters become an equi-join; within a
    cell bounded blocks are scored as matrices and only matches leave. In a block both sides are ordered by price, so a
    wishlist is scored against what it can pay and no more. Nothing is broadcast, and a cell that holds a third of all
    listings becomes many blocks. Expects the columns of the wishlist and listing views; `placed` wishlists are rows of
    `wishlist_rows`."""
    w = wishlists if placed else wishlist_rows(wishlists)
    rows = _listing_cells(listings.where(F.col("status") == "active")).select(
        *CELL, "listing_id", F.col("size_eu").cast("double").alias("size_eu"),
        F.when(F.col("size_source") == "vlm", float(screening.SIZE_SLACK)).otherwise(0.0).alias("slack"),
        F.col("price").cast("double").alias("price"), "embedding")
    return blocks.block_join(w, rows, CELL, "wishlist_id", "listing_id", _block_matches,
                             "wishlist_id long, listing_id long, score double")


def _block_matches(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    """The matches of a block of wishlists and a block of listings of one cell. Only sizes and prices are left to check; an
    unknown price fits every wishlist, and one without a ceiling takes every price."""
    ceiling = a["max_price"].to_numpy(dtype=float)
    ceiling = np.where(np.isnan(ceiling), np.inf, ceiling)
    price = b["price"].to_numpy(dtype=float)
    price = np.where(np.isnan(price), -np.inf, price)
    a, b = a.iloc[np.argsort(ceiling, kind="stable")], b.iloc[np.argsort(price, kind="stable")]
    payable = np.searchsorted(np.sort(price), np.sort(ceiling), side="right")  # listings in reach of each wishlist, rising
    a, b, payable = a.iloc[payable.searchsorted(1):], b.iloc[:payable[-1]], payable[payable > 0]
    found = {"wishlist_id": [a["wishlist_id"].to_numpy()[:0]], "listing_id": [b["listing_id"].to_numpy()[:0]],
             "score": [np.empty(0)]}
    if not len(a):
        return pd.DataFrame({k: v[0] for k, v in found.items()})
    vectors, wanted = blocks.matrix(b["embedding"]).T, blocks.matrix(a["query_vec"])
    wishlists, listings = a["wishlist_id"].to_numpy(), b["listing_id"].to_numpy()
    size, slack = b["size_eu"].to_numpy(dtype=float), b["slack"].to_numpy(dtype=float)
    low, high, least = (a[c].to_numpy(dtype=float) for c in ("size_min", "size_max", "min_score"))
    sized = not (np.isnan(low).all() or np.isnan(size).all())
    start = 0
    while start < len(a):
        # wishlists of like ceilings: as many as fit, up to the first that reaches twice as far
        end = min(start + max(1, STRIPE_SCORES // len(b)), int(payable.searchsorted(2 * payable[start], side="right")))
        cos = wanted[start:end] @ vectors[:, :payable[end - 1]]
        hit = cos >= least[start:end, None]
        if payable[start] < payable[end - 1]:
            hit &= np.arange(cos.shape[1]) < payable[start:end, None]
        at = np.flatnonzero(hit)
        r = np.repeat(np.arange(end - start), np.count_nonzero(hit, axis=1))
        c, score = at - r * cos.shape[1], cos.ravel()[at]
        r += start
        if sized:
            keep = (np.isnan(low[r]) | np.isnan(size[c])
                    | ((size[c] >= low[r] - slack[c]) & (size[c] <= high[r] + slack[c])))
            r, c, score = r[keep], c[keep], score[keep]
        found["wishlist_id"].append(wishlists[r])
        found["listing_id"].append(listings[c])
        found["score"].append(np.round(score, 6))
        start = end
    return pd.DataFrame({k: np.concatenate(v) for k, v in found.items()})


def new_matches_only(matches: DataFrame, stored: DataFrame) -> DataFrame:
    """Matches whose pair is not stored yet, each pair once.

    One order by the pair serves both the repeats and the anti-join: a sort spills, while dropDuplicates would hold all
    pairs of a task in two hash tables besides."""
    keys = ["wishlist_id", "listing_id"]
    once = first_rows(matches, keys, [F.col(k) for k in keys], 1, "_copy").drop("_copy")
    return once.join(stored.select(*keys), keys, "left_anti")


def backfill_matches(wishlists: DataFrame, listings: DataFrame, now: Column) -> DataFrame:
    """Matches of new wishlists with what is already listed, marked as notified so that old listings stay silent."""
    return match_wishlists(wishlists, listings).withColumn("notified_at", now)


def top_matches(matches: DataFrame, limit: int = TOP_MATCHES) -> DataFrame:
    return first_rows(matches, ["wishlist_id"], [F.col("score").desc(), F.col("listing_id")], limit, "place")


def wishlist_match_counts(wishlists: DataFrame, matches: DataFrame) -> DataFrame:
    counts = matches.groupBy("wishlist_id").agg(F.count(F.lit(1)).alias("matches"))
    return wishlists.join(counts, "wishlist_id", "left").withColumn("matches", F.coalesce("matches", F.lit(0)))


def wishlist_limit(wishlists: DataFrame, order: list[Column], limit: int = MAX_ACTIVE_WISHLISTS) -> DataFrame:
    """Active wishlists that are admitted: the first ten of each owner. The rest are the anti-join with these."""
    return first_rows(wishlists.where("active"), ["owner"], order, limit, "place")


def unmatched_listings(listings: DataFrame, posts: DataFrame, now: Column, limit: int = 500) -> DataFrame:
    """Listings of posts finished within the hour that were never checked for matches."""
    recent = posts.where((F.col("status") == "done") & (F.col("updated_at") > now - F.expr("interval 1 hour")))
    waiting = listings.where(F.col("match_checked_at").isNull())
    return waiting.join(recent.select("post_id"), "post_id", "left_semi").orderBy("listing_id").limit(limit)


def pending_notifications(matches: DataFrame, now: Column, order: list[Column], limit: int = OUTBOX_LIMIT) -> DataFrame:
    due = matches.where(F.col("notified_at").isNull() & (F.col("created_at") < now - F.expr("interval 30 seconds"))
                        & (F.col("notify_attempts") < OUTBOX_ATTEMPTS))
    return due.orderBy(*order).limit(limit)


def record_notifications(matches: DataFrame, sent: DataFrame, now: Column) -> DataFrame:
    """Count an attempt for every tried match and stamp the delivered ones. `sent`: wishlist_id, listing_id, ok."""
    keys = ["wishlist_id", "listing_id"]
    tried = matches.join(sent.select(*keys, "ok"), keys, "left")
    open_row = F.col("ok").isNotNull() & F.col("notified_at").isNull()
    return (tried.withColumn("notify_attempts", F.col("notify_attempts") + F.when(open_row, 1).otherwise(0))
            .withColumn("notified_at", F.when(open_row & F.col("ok"), now).otherwise(F.col("notified_at"))).drop("ok"))


def search_listings(listings: DataFrame, *, vector: Column | None = None, size_min=None, size_max=None, max_price=None,
                    brand=None, owner: str | None = None, limit: int = 48) -> DataFrame:
    """Visible active listings under the filters. With a size: exact sizes first, then model-read ones within the
    slack, then unknown ones; within each by similarity to the vector, else newest first. A top-k sort, no full one."""
    rows = screening.visible_to(listings.where(F.col("status") == "active"), owner)
    rows = screening.listing_filters(rows, size_min=size_min, size_max=size_max, max_price=max_price, brand=brand)
    score = F.lit(None).cast("double") if vector is None else blocks.score_column(cosine(F.col("embedding"), vector))
    rows = rows.withColumn("score", score)
    if size_min is None:
        rows = rows.withColumn("fit", F.lit(0))
    else:
        exact = F.col("size_eu").between(F.lit(size_min).cast("decimal(4,1)"), F.lit(size_max).cast("decimal(4,1)"))
        rows = rows.withColumn("fit", F.when(exact, 0).when(F.col("size_eu").isNotNull(), 1).otherwise(2))
    by = F.col("last_seen").desc() if vector is None else F.col("score").desc()
    return rows.orderBy("fit", by, F.col("listing_id").desc()).limit(limit)


def feed_page(listings: DataFrame, *, cursor: tuple[Column, Column] | None = None, limit: int = 24) -> DataFrame:
    """Active listings, newest first, strictly after the cursor (last_seen, listing_id) of the previous page."""
    rows = listings.where(F.col("status") == "active")
    if cursor is not None:
        seen, lid = cursor
        rows = rows.where((F.col("last_seen") < seen) | ((F.col("last_seen") == seen) & (F.col("listing_id") < lid)))
    return rows.orderBy(F.col("last_seen").desc(), F.col("listing_id").desc()).limit(limit)


def nearest(queries: DataFrame, listings: DataFrame, k: int, *, query_id: str, query_post: str | None = None,
            query_session: str | None = None, descending_id: bool = False,
            rows_per_pivot: int = cells.ROWS_PER_PIVOT) -> DataFrame:
    """The k most similar listings per query row: (query id, listing_id, cos, place). Queries: query id, query_vec;
    listings: listing_id, embedding and, for the exclusions, post_id and owner_session.

    Exact, best cells first: a query visits the cells with the smallest lower bounds of their angle until they hold a
    few times k rows; the k-th score found there then rules out every other cell whose bound is beyond it, and the rest
    are visited. A cell ships its k best per query."""
    sign = -1 if descending_id else 1
    session = F.coalesce(F.col(query_session), F.lit("")) if query_session else F.lit("")
    left = queries.where(F.col("query_vec").isNotNull()).select(
        F.col(query_id).alias("query_id"), "query_vec", session.alias("for_session"),
        (F.col(query_post) if query_post else F.lit(-1)).cast("long").alias("for_post"))
    index = cells.Index(listings.select(
        "listing_id", "embedding", F.col("post_id").cast("long").alias("post_id"),
        (F.coalesce("owner_session", F.lit("")) if query_session else F.lit("")).alias("session")), "embedding",
        rows_per_pivot)
    if not len(index.table.cells):
        return left.limit(0).select(F.col("query_id").alias(query_id), F.lit(0).cast("long").alias("listing_id"),
                                    F.lit(0.0).alias("cos"), F.lit(0).alias("place"))

    def score(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        ids, posts, sessions = (b[c].to_numpy() for c in ("listing_id", "post_id", "session"))
        asked, own, mine = (a[c].to_numpy() for c in ("query_id", "for_post", "for_session"))
        free = sessions == ""
        allowed = lambda r, c: (posts[c] != own[r]) & (free[c] | (sessions[c] == mine[r]))
        r, c, cos = blocks.best_pairs(blocks.Vectors(a["query_vec"]), blocks.Vectors(b["embedding"]), sign * ids, k, allowed,
                                      a["least"].to_numpy())
        return pd.DataFrame({"query_id": asked[r], "listing_id": ids[c], "cos": cos})

    by_id = F.col("listing_id").desc() if descending_id else F.col("listing_id")

    def best(rows: DataFrame) -> DataFrame:
        return first_rows(rows, ["query_id"], [F.col("cos").desc(), by_id], k, "place")

    def met(rows: DataFrame, others: DataFrame, cell: str) -> DataFrame:
        return blocks.block_join(rows, others, [cell], "query_id", "listing_id", score, "query_id long, listing_id long, cos double",
                                 rows_per_block)

    def wave(rows: DataFrame, visited: Column) -> DataFrame:
        return met(rows.withColumn("cell", F.explode(visited)).select(*left.columns, "least", "cell"), index.rows, "cell")

    wanted, rows_per_block = FIRST_WAVE * k, blocks.vector_rows(index.rows, "embedding")
    first = cut_lineage(best(wave(left.withColumn("least", F.lit(-2.0)), index.visits(F.col("query_vec"), wanted))))
    kth = first.where(F.col("place") == k).select("query_id", F.col("cos").alias("least"))
    open_ = left.join(kth, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(-2.0)))
    visits = index.visits(F.col("query_vec"), wanted, F.col("least"))
    some = open_.where(F.pmod(F.xxhash64("query_id"), F.lit(cells.SAMPLED)) == 0)
    copies = some.agg(F.avg(F.size(visits))).first()[0] or 0.0
    # where cells skip little, a copy of a query per cell costs more than a copy per block of all cells
    if copies > max(cells.FEW_COPIES, 2 * int(index.table.sizes.sum()) / rows_per_block):
        second = met(open_.withColumn("_all", F.lit(0)), index.rows.withColumn("_all", F.lit(0)), "_all")
        return best(second).withColumnRenamed("query_id", query_id)
    second = wave(open_, visits)
    return best(first.drop("place").unionByName(second)).withColumnRenamed("query_id", query_id)


def brand_vote(neighbours: DataFrame, query: str, min_votes: int = MIN_VOTES) -> DataFrame:
    """The brand that at least `min_votes` of a query's neighbours carry. Expects brand and cos."""
    votes = neighbours.groupBy(query, "brand").agg(F.count(F.lit(1)).alias("votes"))
    return votes.where(F.col("votes") >= min_votes)


def knn_brand(queries: DataFrame, listings: DataFrame, *, query_id: str, query_post: str, query_session: str,
              min_cos: float = MIN_NEIGHBOUR_COS) -> DataFrame:
    """A brand by majority among the five nearest listings whose brand came from a trusted source; the query's own
    post and other sessions' uploads are left out, and the nearest must be close enough."""
    trusted = listings.where(F.col("brand").isNotNull() & F.col("brand_source").isin(*TRUSTED_BRAND_SOURCES))
    near = nearest(queries, trusted, NEIGHBOURS, query_id=query_id, query_post=query_post, query_session=query_session)
    named = near.join(trusted.select("listing_id", "brand"), "listing_id")
    tops = named.groupBy(query_id).agg(F.max("cos").alias("top_cos")).where(F.col("top_cos") >= min_cos)
    return brand_vote(named, query_id).join(tops, query_id)


def zero_shot_label(items: DataFrame, labels: DataFrame, *, item_id: str, vector: str, floor: float = LABEL_FLOOR,
                    margin: float = LABEL_MARGIN) -> DataFrame:
    """The label whose vector is closest to an item's (dot product of unit vectors) where it clears the floor and beats
    the runner-up by the margin; with one label the runner-up is -1. Labels: label, label_vec."""
    near = nearest(items.select(F.col(item_id), F.col(vector).alias("query_vec")),
                   labels.select(F.col("label").cast("long").alias("listing_id"), F.col("label_vec").alias("embedding"),
                                 F.lit(-2).alias("post_id")), 2, query_id=item_id)
    ranked = near.groupBy(item_id).agg(
        F.max(F.when(F.col("place") == 1, F.col("listing_id"))).alias("label"),
        F.max(F.when(F.col("place") == 1, F.col("cos"))).alias("top"),
        F.coalesce(F.max(F.when(F.col("place") == 2, F.col("cos"))), F.lit(-1.0)).alias("second"))
    return ranked.where((F.col("top") >= floor) & (F.round(F.col("top") - F.col("second"), 6) >= margin))
