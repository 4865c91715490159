"""Vector joins in cells against all pairs, and how much they skip."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from bazaarlens.operators import blocks, cells, matching, reposts


def clustered(seed, n, dims=16, centres=40, noise=0.05):
    r = np.random.default_rng(seed)
    c = r.standard_normal((centres, dims))
    v = c[r.integers(0, centres, n)] + noise * r.standard_normal((n, dims))
    v[0] = 0  # a vector without a direction
    v[1:4] = v[4]  # copies
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def listings(spark, v):
    n = len(v)
    hot = [0 if i < n // 3 else 1 + i % 20 for i in range(n)]  # one seller holds a third
    rows = [(i, i * 10, hot[i], v[i].tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "listing_id long, post_id long, seller long, embedding array<double>").withColumn(
        "last_seen", F.timestamp_seconds(F.lit(1704067200) + F.col("listing_id") * 600)), np.array(hot)


@pytest.mark.parametrize("rows_per_pivot", [8, 2048])
def test_range_join(spark, rows_per_pivot):
    v = clustered(1, 1500)
    frame, hot = listings(spark, v)
    frame = frame.withColumn("embedding", F.when(F.col("listing_id") != 7, F.col("embedding")))
    new = frame.select("post_id", F.lit(0).alias("segment_idx"), "seller", F.col("last_seen").alias("ref_time"), "embedding")
    got = {r["post_id"]: (r["listing_id"], round(r["cos"], 6))
           for r in reposts.repost_by_embedding(new, frame, window_days=5, rows_per_pivot=rows_per_pivot).collect()}
    cos = np.round(v @ v.T, 6)
    at = np.arange(len(v))
    ok = ((hot[:, None] == hot[None, :]) & (at[:, None] != at[None, :]) & (at[None, :] * 600 > at[:, None] * 600 - 5 * 86400)
          & (cos >= 0.96) & (at[:, None] != 7) & (at[None, :] != 7))
    want = {}
    for i in np.flatnonzero(ok.any(axis=1)):
        best = np.where(ok[i], cos[i], -9)
        want[i * 10] = (int(best.argmax()), float(best.max()))
    assert got == want and len(want) > 500
    bands = {r["cos_from"]: r["pairs"] for r in reposts.cosine_bands(frame, rows_per_pivot=rows_per_pivot).collect()}
    both = (hot[:, None] == hot[None, :]) & (at[:, None] < at[None, :]) & (at[:, None] != 7) & (at[None, :] != 7)
    counts = {lo: int((both & (cos >= lo) & (cos < hi)).sum()) for lo, hi in reposts.COSINE_BANDS}
    assert bands == {lo: n for lo, n in counts.items() if n}


def test_range_join_skips(spark):
    v = clustered(2, 3000)
    frame, hot = listings(spark, v)
    left, right = cells.meet_within(frame.select("listing_id", "seller", "embedding"), frame.select(
        "listing_id", "seller", F.col("embedding").alias("other")), ["seller"], "embedding", "other", cells.reach_of(0.96), 16)
    every = sum(int(n) ** 2 for n in np.bincount(hot))
    assert cells.scored_pairs(left, right, ["seller", "cell", "ring"]) < every / 10


@pytest.mark.parametrize("seed, n, k, rows_per_pivot", [(3, 1200, 5, 16), (4, 300, 400, 16), (5, 900, 3, 2048)])
def test_nearest(spark, seed, n, k, rows_per_pivot):
    v = clustered(seed, n)
    frame, _ = listings(spark, v)
    frame = frame.withColumn("owner_session", F.when(F.col("listing_id") % 3 == 0, F.concat(
        F.lit("u"), (F.col("listing_id") % 2).cast("string"))))
    q = np.vstack([v[:50], clustered(seed + 90, 30)])
    queries = spark.createDataFrame([(i, x.tolist(), i * 10, f"u{i % 2}") for i, x in enumerate(q)],
                                    "q long, query_vec array<double>, post long, session string")
    got = matching.nearest(queries, frame, k, query_id="q", query_post="post", query_session="session",
                           rows_per_pivot=rows_per_pivot).toPandas()
    at, want = np.arange(n), []
    for i, x in enumerate(q):
        cos = np.round(x @ v.T, 6)
        ok = (at != i) & ((at % 3 != 0) | (at % 2 == i % 2))
        order = sorted(at[ok], key=lambda j: (-cos[j], j))[:k]
        want += [(i, int(j), float(cos[j]), p + 1) for p, j in enumerate(order)]
    got["cos"] += 0.0
    assert sorted(map(tuple, got[["q", "listing_id", "cos", "place"]].itertuples(index=False))) == sorted(want)


def test_search_skips():
    """On clustered vectors the two waves look at less than a tenth of all pairs."""
    v = clustered(6, 4000)
    pivots = v[np.random.default_rng(0).choice(4000, 64, replace=False)]
    angles = np.arccos(np.clip(v @ pivots.T, -1, 1))
    cell = (angles.argmin(axis=1) + 1) * cells._RINGS + (angles.min(axis=1) / cells.RING).astype(int)
    names, at = np.unique(cell, return_inverse=True)
    own = np.array([[angles[at == c].min(axis=1).min(), angles[at == c].min(axis=1).max()] for c in range(len(names))])
    refs = np.array([[angles[at == c, :8].min(axis=0), angles[at == c, :8].max(axis=0)] for c in range(len(names))])
    table = cells.CellTable(names, np.bincount(at), own, refs)
    cos = np.sort(v @ v.T, axis=1)[:, ::-1]
    size = dict(zip(names, np.bincount(at)))
    seen = sum(size[c] for wave in (None, cos[:, 4]) for row in table.visits(angles, 20, wave) for c in row)
    assert seen < 4000 * 4000 / 10


def test_nothing_to_meet(spark):
    frame, _ = listings(spark, clustered(7, 10))
    frame = frame.withColumn("owner_session", F.lit(None).cast("string"))
    queries = frame.select(F.col("listing_id").alias("q"), F.col("embedding").alias("query_vec"))
    assert matching.nearest(queries, frame.limit(0), 3, query_id="q").count() == 0
    assert matching.nearest(queries.limit(0), frame, 3, query_id="q").count() == 0
    assert isinstance(matching.nearest(queries, frame, 3, query_id="q").toPandas(), pd.DataFrame)


def scattered(seed, n, dims=64):
    v = np.random.default_rng(seed).standard_normal((n, dims))
    v[1:4] = v[4] + 0.01 * v[1:4]
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def test_no_copy_per_cell_where_cells_skip_nothing(spark, monkeypatch):
    monkeypatch.setattr(cells, "SAMPLED", 1)
    v = scattered(8, 600)
    frame = listings(spark, v)[0].withColumn("seller", F.col("listing_id") % 2)
    left, right = cells.meet_within(frame.select("listing_id", "seller", "embedding"), frame.select(
        "listing_id", "seller", F.col("embedding").alias("other")), ["seller"], "embedding", "other", cells.reach_of(0.88), 8)
    assert left.count() == right.count() == 600
    got = {r["cos_from"]: r["pairs"] for r in reposts.cosine_bands(frame, [(0.3, 0.5), (0.5, 1.01)], rows_per_pivot=8).collect()}
    cos, at = np.round(v @ v.T, 6), np.arange(600)
    both = (at[:, None] % 2 == at[None, :] % 2) & (at[:, None] < at[None, :])
    assert got == {lo: int((both & (cos >= lo) & (cos < hi)).sum()) for lo, hi in ((0.3, 0.5), (0.5, 1.01))}


def test_nearest_meets_blocks_where_cells_skip_nothing(spark, monkeypatch):
    monkeypatch.setattr(cells, "SAMPLED", 1)
    met, join = [], blocks.block_join
    monkeypatch.setattr(blocks, "block_join", lambda a, b, keys, *more, **named: met.append(keys) or join(a, b, keys, *more, **named))
    v = scattered(9, 700)
    frame = listings(spark, v)[0].withColumn("owner_session", F.lit(None).cast("string"))
    queries = frame.where("listing_id < 60").select(F.col("listing_id").alias("q"), F.col("embedding").alias("query_vec"))
    got = matching.nearest(queries, frame, 5, query_id="q", descending_id=True, rows_per_pivot=8).toPandas()
    cos, at, want = np.round(v[:60] @ v.T, 6), np.arange(700), []
    for i in range(60):
        want += [(i, int(j), p + 1) for p, j in enumerate(sorted(at, key=lambda j: (-cos[i, j], -j))[:5])]
    assert sorted(got[["q", "listing_id", "place"]].itertuples(index=False, name=None)) == sorted(want)
    assert met == [["cell"], ["_all"]]


def test_products_in_single_precision_change_nothing(monkeypatch):
    monkeypatch.setattr(blocks, "TILE", (7, 32))
    v, w = scattered(10, 50, 8), np.vstack([scattered(11, 120, 8), scattered(10, 50, 8)])
    a, b = (blocks.Vectors(pd.Series(list(3 * x))) for x in (v, w))
    cos = np.round(v @ w.T, 6)
    got = [np.concatenate(x) for x in zip(*blocks.near_pairs(a, b, 0.5))]
    assert sorted(zip(*(x.tolist() for x in got[:2]))) == sorted(zip(*(x.tolist() for x in np.nonzero(cos >= 0.5))))
    assert np.array_equal(got[2], cos[got[0], got[1]])
    ids, allowed = np.arange(170) % 60, lambda r, c: (r + c) % 3 > 0
    for k, least in ((3, -2.0), (40, -2.0), (200, 0.1)):
        r, c, score = blocks.best_pairs(a, b, ids, k, allowed, np.full(50, least))
        for i in range(50):
            fits = [j for j in range(170) if (i + j) % 3 and cos[i, j] >= least]
            want = sorted(((-cos[i, j], int(ids[j])) for j in fits))[:k]
            assert sorted(zip((-score[r == i]).tolist(), ids[c[r == i]].tolist())) == want
