"""Repost, matching and vector operators against brute force on small random data, with blocks far below their size."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bazaarlens.operators import blocks, hashes, matching, reposts

DAY0 = dt.datetime(2024, 1, 1)


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    monkeypatch.setattr(blocks.block_join, "__defaults__", (7,))


def near_hashes(rng, n, flips):
    base = [rng.getrandbits(64) - 2 ** 63 for _ in range(6)]
    out = []
    for _ in range(n):
        h = rng.choice(base) & (2 ** 64 - 1)
        for _ in range(rng.randrange(flips + 1)):
            h ^= 1 << rng.randrange(64)
        out.append(h - 2 ** 64 if h >= 2 ** 63 else h)
    return out


def distance(a, b):
    return bin((a ^ b) & (2 ** 64 - 1)).count("1")


@pytest.mark.parametrize("limit,spare", [(2, 1), (2, 2), (6, 2), (3, 3)])
def test_hash_pairs_find_every_pair(spark, limit, spare):
    values = sorted(set(near_hashes(random.Random(limit), 120, 5)))
    df = spark.createDataFrame([(v,) for v in values], "phash long")
    got = {(r.a, r.b, r.distance) for r in hashes.self_pairs(df, limit, spare).collect()}
    want = {(a, b, distance(a, b)) for i, a in enumerate(values) for b in values[i + 1:] if distance(a, b) <= limit}
    assert got == want
    both = {(r.a, r.b) for r in hashes.hash_pairs(df, df, limit, spare).collect()}
    assert both == {(a, b) for a in values for b in values if distance(a, b) <= limit}


PHOTO = "post_id long, segment_idx int, phash long, seller string, owner string, ref_time timestamp"
KNOWN = "phash long, listing_id long, post_id long, seller string, owner string, last_seen timestamp"


def test_repost_rules(spark):
    """Half rule, seller distances, window, own post and owner."""
    known = spark.createDataFrame([
        (0b0, 1, 100, "s", None, DAY0), (0b11111111 << 20, 2, 101, "s", None, DAY0),
        (0x3FF << 50, 3, 102, "t", "u1", DAY0)], KNOWN)
    day = dt.timedelta(days=1)

    def hit(photos, seller="s", at=DAY0, post=7, owner=None):
        new = spark.createDataFrame([(post, 0, p, seller, owner, at) for p in photos], PHOTO)
        rows = reposts.repost_by_hash(new, known, max_distance=6, cross_distance=2).collect()
        return [(r.listing_id, r.matched) for r in rows]

    six, eight, two = 0b111111, 0b11111111, 0b11
    assert hit([six]) == [(1, 1)] and hit([eight]) == []
    assert hit([six], seller="z") == [] and hit([two], seller="z") == [(1, 1)]
    far = [0x7777 << 40, 0x5555 << 40]
    assert hit([0, far[0]]) == [(1, 1)] and hit([0, *far]) == []
    assert hit([0], at=DAY0 + 89 * day) == [(1, 1)] and hit([0], at=DAY0 + 91 * day) == []
    assert hit([0], post=100) == []
    assert hit([0x3FF << 50], seller="t") == [] and hit([0x3FF << 50], seller="t", owner="u1") == [(3, 1)]
    assert hit([0, 0, far[0]]) == [(1, 2)]  # two photos with one hash count twice


def vectors(rng, n):
    base = rng.normal(size=(5, 8))
    v = base[rng.integers(0, 5, n)] + rng.normal(size=(n, 8)) * rng.choice([0, 0.05, 0.5], size=(n, 1))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def test_embedding_repost_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    v = vectors(rng, 60)
    rows = [(i, i, 0, int(rng.integers(0, 3)), DAY0 + dt.timedelta(days=int(rng.integers(0, 120))),
             [float(x) for x in v[i]]) for i in range(60)]
    df = spark.createDataFrame(rows, "listing_id long, post_id long, segment_idx int, seller int, last_seen timestamp, "
                                     "embedding array<double>")
    got = {r.post_id: (r.listing_id, r.cos) for r in reposts.repost_by_embedding(
        df.select("post_id", "segment_idx", "seller", F.col("last_seen").alias("ref_time"), "embedding"), df).collect()}
    want = {}
    for i, _, _, seller, at, _ in rows:
        best = [(-round(float(v[i] @ v[j]), 6), j) for j, _, _, s, seen, _ in rows
                if s == seller and j != i and seen > at - dt.timedelta(days=90)]
        if best and -min(best)[0] >= 0.96:
            want[i] = (min(best)[1], -min(best)[0])
    assert got == want and want


def test_nearest_and_votes(spark):
    rng = np.random.default_rng(4)
    v, q = vectors(rng, 50), vectors(rng, 20)
    listings = spark.createDataFrame([(i, i, None, "ABC"[i % 3], "ocr" if i % 4 else "knn", [float(x) for x in v[i]])
                                      for i in range(50)],
                                     "listing_id long, post_id long, owner_session string, brand string, "
                                     "brand_source string, embedding array<double>")
    queries = spark.createDataFrame([(i, i, "u", [float(x) for x in q[i]]) for i in range(20)],
                                    "qid long, post long, session string, query_vec array<double>")
    got = {}
    for r in matching.nearest(queries, listings, 4, query_id="qid").orderBy("qid", "place").collect():
        got.setdefault(r.qid, []).append(r.listing_id)
    scores = np.round(q @ v.T, 6)
    assert got == {i: [j for _, j in sorted((-scores[i, j], j) for j in range(50))[:4]] for i in range(20)}
    votes = {r.qid: r.brand for r in matching.knn_brand(queries, listings, query_id="qid", query_post="post",
                                                         query_session="session", min_cos=0.5).collect()}
    want = {}
    for i in range(20):
        five = sorted((-scores[i, j], j) for j in range(50) if j % 4 and j != i)[:5]
        names = ["ABC"[j % 3] for _, j in five]
        top = max(set(names), key=names.count)
        if names.count(top) >= 3 and -five[0][0] >= 0.5:
            want[i] = top
    assert votes == want and want


def test_match_rules(spark):
    """The truth table of one wishlist: Nike, 42, at most 5000, score at least 0.5."""
    near, away = [1.0, 0.0], [0.3, 0.954]
    rows = [(1, "Nike", 42, "caption", 4000, near), (2, "Nike", None, None, None, near),
            (3, "Nike", 42, "caption", 6000, near), (4, "Nike", 44, "caption", 4000, near),
            (5, "Puma", 42, "caption", 4000, near), (6, "Jordan", 42, "caption", 4000, near),
            (7, "Nike", 42, "caption", 4000, away), (8, "Nike", 43, "vlm", 4000, near),
            (9, "Nike", 44, "vlm", 4000, near), (10, None, 42, "caption", 4000, near),
            (11, "nike", 41, "vlm", 5000, near)]
    listings = spark.createDataFrame(rows, "listing_id long, brand string, size_eu int, size_source string, price int, "
                                           "embedding array<double>").withColumns({
        "size_eu": F.col("size_eu").cast("decimal(4,1)"), "status": F.lit("active"), "source": F.lit("chat_export"),
        "owner_session": F.lit(None).cast("string")})
    wish = spark.createDataFrame([(1, "local", "Nike", 42, 42, 5000, True), (2, "local", None, None, None, None, True),
                                  (3, "u1", "Nike", 42, 42, 5000, True), (4, "local", "Nike", 42, 42, 5000, False),
                                  (5, "local", None, 40, 42, None, True)],
                                 "wishlist_id long, owner string, brand string, size_min int, size_max int, "
                                 "max_price int, active boolean").withColumns({
        "size_min": F.col("size_min").cast("decimal(4,1)"), "size_max": F.col("size_max").cast("decimal(4,1)"),
        "min_score": F.lit(0.5), "query_vec": F.array(F.lit(1.0), F.lit(0.0))})
    got = {}
    for r in matching.match_wishlists(wish, listings).collect():
        got.setdefault(r.wishlist_id, []).append(r.listing_id)
    assert {w: sorted(ids) for w, ids in got.items()} == {
        1: [1, 2, 6, 8, 11], 2: [1, 2, 3, 4, 5, 6, 8, 9, 10, 11], 5: [1, 2, 3, 5, 6, 8, 10, 11]}


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(i, i + 1) for i in range(100, 140)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r.node: r.root for r in reposts.connected_components(
        spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for e in edges for n in e if e[0] != e[1]} | {n: find(n) for n in got}
    assert all(find(n) == r for n, r in got.items())


def test_fold_fills_and_keeps(spark):
    base = spark.createDataFrame([(1, "Nike", "caption", None, None, None, 5000, "caption", None, False, 0, DAY0, DAY0)],
                                 "listing_id long, brand string, brand_source string, size_label string, size_eu "
                                 "decimal(4,1), size_source string, price int, price_source string, currency string, "
                                 "price_on_request boolean, repost_count int, first_seen timestamp, last_seen timestamp").withColumn(
        "size_approx", F.lit(None).cast("boolean"))
    later, sooner = DAY0 + dt.timedelta(days=9), DAY0 - dt.timedelta(days=9)
    facts = spark.createDataFrame([(1, 8, 0, later, 4200, "Puma", "EU 42", "PKR", False, "ocr", 1),
                                   (1, 9, 0, sooner, None, None, "EU 44", None, True, "caption", 2),
                                   (1, 8, 0, later, 1, None, None, None, False, "caption", 3)],
                                  "listing_id long, post_id long, segment_idx int, seen_at timestamp, price int, brand "
                                  "string, size_label string, currency string, price_on_request boolean, source string, "
                                  "place int").withColumn("size_eu", F.lit(None).cast("decimal(4,1)")).withColumn(
        "size_approx", F.col("place") == 1)
    new = reposts.new_sightings(facts, None, [F.col("place")])
    r = reposts.repost_fold(base, new, [F.col("place")]).first()
    assert (r.brand, r.size_label, r.size_source, r.price, r.price_source) == ("Nike", "EU 42", "ocr", 4200, "ocr")
    assert (r.repost_count, r.currency, r.price_on_request, r.size_approx) == (2, "PKR", True, True)
    assert (r.first_seen, r.last_seen) == (sooner, later)
    assert reposts.new_sightings(facts, facts, [F.col("place")]).count() == 0
