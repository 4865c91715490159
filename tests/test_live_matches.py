"""Matches against plain Python, who meets whom, and what the ledger of live matches writes."""

import random

import numpy as np
from pyspark.sql import functions as F

from bazaarlens.operators import cells, matching
from bazaarlens.sources.store import VERSIONS, BucketTable
from bazaarlens.streaming import jobs

WISH = ("wishlist_id long, owner string, brand string, size_min double, size_max double, max_price int, active boolean, "
        "min_score double, query_vec array<double>")
LISTING = ("listing_id long, brand string, size_eu double, size_source string, price int, status string, source string, "
           "owner_session string, embedding array<double>")


def vector(r):
    v = [r.gauss(0, 1) for _ in range(6)]
    return v if r.random() < 0.95 else [0.0] * 6


def wishes(r, n):
    for i in range(n):
        size = r.choice([None, 40.0, 41.5])
        yield (i, r.choice(["local", "u1", "u2", None, "demo_seed", ""]), r.choice([None, "Nike", "puma"]), size,
               size and r.choice([size, size + 2, None]), r.choice([None, 900, 900, 1500, 10]), r.random() < 0.9, 0.1, vector(r))


def goods(r, ids):
    for i in ids:
        yield (i, r.choice([None, "nike", "Puma"]), r.choice([None, 39.0, 40.0, 40.5, 42.0]), r.choice([None, "vlm", "caption"]),
               r.choice([None, 800, 900, 901, 1500, 2000]), r.choice(["active", "active", "active", "sold"]),
               r.choice(["demo_seed", "chat", None]), r.choice([None, "u1", "u2", "local"]), vector(r))


def fits(w, x):
    _, owner, brand, low, high, ceiling, active, least, q = w
    _, b, size, sized_by, price, status, source, session, v = x
    slack = 1 if sized_by == "vlm" else 0
    cos = float(np.dot(q, v) / max(np.linalg.norm(q), 1e-12) / max(np.linalg.norm(v), 1e-12))
    return (active and status == "active" and (brand is None or (b or "").lower() == brand.lower())
            and (low is None or size is None or (high is not None and low - slack <= size <= high + slack))
            and (ceiling is None or price is None or price <= ceiling)
            and (owner == "local" or source == "demo_seed" or (owner is not None and (session or "") == owner)) and cos >= least)


def test_matches_of_plain_rules(spark):
    r = random.Random(8)
    w, x = list(wishes(r, 90)), list(goods(r, range(200)))
    wish, listed = spark.createDataFrame(w, WISH), spark.createDataFrame(x, LISTING)
    got = [tuple(m)[:2] for m in matching.match_wishlists(wish, listed).collect()]
    want = {(a[0], b[0]) for a in w for b in x if fits(a, b)}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 400


def test_only_visible_listings_meet(spark):
    """Wishlists of a session meet seeds and its own listings, so three in four of these pairs are never scored."""
    w = [(i, f"u{i % 8}", None, None, None, None, True, 0.1, [1.0]) for i in range(80)]
    x = [(i, None, None, None, None, "active", "demo_seed" if i % 8 == 0 else "chat", f"u{i % 8}", [1.0]) for i in range(80)]
    sides = matching.wishlist_rows(spark.createDataFrame(w, WISH)), matching._listing_cells(spark.createDataFrame(x, LISTING))
    assert cells.scored_pairs(*sides, matching.CELL) == sum(fits(a, b) for a in w for b in x) < 80 * 80 / 4


def test_ledger_of_batches(spark):
    """Listings that come twice, again and changed, wishlists that come twice, and a replay: every pair once, as first
    stored, and no file of the ledger is written twice."""
    r = random.Random(9)
    w, x = list(wishes(r, 40)), list(goods(r, range(60)))
    twice = [x[3], x[3], *goods(r, [4])]
    batches = [[*x[:40], *twice], [*x[40:], *goods(r, [1, 2, 41])], x[40:]]
    for wish in (w, [*w, w[0], w[1], *wishes(r, 3)]):
        ledger = BucketTable.new(spark, "matches", jobs.MATCHES, ["listing_id"], buckets=4)
        handle = jobs.match_batch(spark.createDataFrame(wish, WISH), ledger)
        want, files = set(), set()
        for k, batch in enumerate(batches):
            handle(spark.createDataFrame(batch, LISTING), k)
            want |= {(a[0], b[0]) for a in wish for b in batch if fits(a, b)}
            rows = [tuple(m)[:2] for m in ledger.read().collect()]
            assert len(rows) == len(set(rows)) and set(rows) == want
            kept = set(ledger.read().inputFiles())
            assert files <= kept
            files = kept


def test_many_appends_become_one_version(spark):
    table = BucketTable.new(spark, "t", "k long", ["k"], buckets=2)
    for i in range(VERSIONS + 2):
        table.append(spark.range(i * 10, i * 10 + 10).select(F.col("id").alias("k")))
        assert all(len(v) <= VERSIONS for v in table.versions().values())
    assert sorted(r["k"] for r in table.read().collect()) == list(range(10 * VERSIONS + 20))
    assert table.append(spark.createDataFrame([], "k long")) == []
