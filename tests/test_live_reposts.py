"""Live reposts against posts taken one by one, and what the bucketed tables read and rewrite."""

import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F

from bazaarlens.sources.store import BucketTable
from bazaarlens.streaming import jobs

DAY0 = dt.datetime(2024, 1, 1)
PHOTO = ("post_id long, segment_idx int, seq int, phash long, seller string, owner string, ref_time timestamp, "
         "embedding array<double>")


def signed(h):
    return h - 2 ** 64 if h >= 2 ** 63 else h


def posts(rng, n):
    r = np.random.default_rng(3)
    base = [rng.getrandbits(64) for _ in range(5)]
    centres = r.standard_normal((4, 8))
    for i in range(n):
        hashes = []
        for _ in range(rng.choice([1, 1, 2, 3])):
            h = rng.choice([*base, rng.getrandbits(64)])
            for _ in range(rng.randrange(3)):
                h ^= 1 << rng.randrange(64)
            hashes.append(signed(h))
        v = centres[rng.randrange(4)] + 0.15 * r.standard_normal(8)
        yield i, hashes, rng.choice("ab"), rng.choice([None, None, "u"]), rng.randrange(300), v / np.linalg.norm(v)


def one_by_one(rows):
    listings, out = {}, {}
    for i, hashes, seller, owner, day, v in rows:
        found, kind = None, "new"
        open_ = {k: x for k, x in listings.items() if x["day"] > day - 90}
        near = {k: sum(any(bin((h ^ g) & (2 ** 64 - 1)).count("1") <= 2 for g in x["hashes"]) for h in hashes)
                for k, x in open_.items() if x["owner"] == owner}
        near = {k: n for k, n in near.items() if n}
        if near:
            best = min(near, key=lambda k: (-near[k], k))
            if near[best] >= -(-len(hashes) // 2):
                found, kind = best, "phash"
        if found is None:
            like = {k: round(float(v @ x["v"]), 6) for k, x in open_.items() if x["seller"] == seller}
            like = {k: c for k, c in like.items() if c >= 0.96}
            if like:
                found, kind = min(like, key=lambda k: (-like[k], k)), "embedding"
        if found is None:
            found = i
            listings[i] = {"seller": seller, "owner": owner, "day": day, "hashes": [], "v": v}
        x = listings[found]
        x["day"], x["hashes"] = max(x["day"], day), x["hashes"] + hashes
        out[i] = (found, kind)
    return out


def test_batches_equal_one_by_one(spark):
    rows = list(posts(random.Random(4), 60))
    state = jobs.RepostState(spark)
    handle = jobs.repost_batch(state, lambda df: df)
    photos = [(i, 0, k, h, s, o, DAY0 + dt.timedelta(days=d), v.tolist()) for i, hs, s, o, d, v in rows for k, h in enumerate(hs)]
    batches = [[p for p in photos if lo <= p[0] < hi] for lo, hi in ((0, 35), (35, 60))]
    for batch in (*batches, batches[1]):  # the last one is a replay
        handle(spark.createDataFrame(batch, PHOTO), 0)
    got = {r["post_id"]: (r["listing_id"], r["kind"]) for r in state.sightings.read().collect()}
    want = one_by_one(rows)
    assert got == want and {k for _, k in want.values()} == {"new", "phash", "embedding"}
    assert state.sightings.read().count() == 60


def test_a_change_touches_its_buckets_only(spark):
    rows = spark.range(1000).select(F.col("id").alias("k"), F.lit(0).alias("v"))
    table = BucketTable.new(spark, "t", rows.schema, ["k"], buckets=16)
    assert table.append(rows) == list(range(16))
    before = {f for f in table.read().inputFiles()}
    changed = rows.where("k in (5, 7)").withColumn("v", F.lit(9))
    touched = table.upsert(changed, ["k"], [F.col("v")])
    after = {f for f in table.read().inputFiles()}
    assert 1 <= len(touched) <= 2
    assert {f.rsplit("bucket=")[1].split("/")[0] for f in after - before} == {str(b) for b in touched}
    assert len(before & after) == len(before) - len(touched)
    read = table.read(touched).inputFiles()
    assert all(f"bucket={b}/" in " ".join(read) for b in touched) and len(read) == len(touched)
    assert {(r["k"], r["v"]) for r in table.read().collect()} == {(i, 9 if i in (5, 7) else 0) for i in range(1000)}
    # a change that died before its manifest line is not there
    rows.withColumn("bucket", table.bucket()).write.partitionBy("bucket").parquet(f"{table.path}/data/version=99")
    assert table.read().where("v = 9").count() == 2


def test_hash_reposts_against_all_pairs(spark):
    """Hot hashes, listings with equal photo sets, posts in several listings, two distances, windows and owners."""
    from bazaarlens.operators import reposts
    rng = random.Random(12)
    base = [rng.getrandbits(64) for _ in range(3)]
    near = lambda: signed(rng.choice([base[0], base[0], base[1], base[2]]) ^ (1 << rng.randrange(64)) * rng.choice([0, 0, 1]))
    listings = {i: (rng.choice("ab"), rng.choice([None, "u"]), rng.randrange(200)) for i in range(40)}
    known = [(near(), i, rng.choice([100 + i, rng.randrange(100, 140)]), *listings[i]) for i in listings for _ in range(rng.choice([1, 1, 2, 3]))]
    new = [(p, s, near(), rng.choice("ab"), rng.choice([None, "u"]), rng.randrange(200)) for p in range(100, 140) for s in (0, 1)]
    new = [(p, s, h, *rest) for p, s, h0, *rest in new for h in {h0, near(), near()}]
    at = lambda d: DAY0 + dt.timedelta(days=d)
    for most, cross in ((2, 2), (4, 1)):
        want = {}
        for p, s in {x[:2] for x in new}:
            mine = [x for x in new if x[:2] == (p, s)]
            score = {}
            for i, (seller, owner, day) in listings.items():
                n = 0
                for _, _, h, sel, own, ref in mine:
                    limit = most if sel == seller else cross
                    n += owner == own and day > ref - 90 and any(
                        i == j and q != p and bin((g ^ h) & (2 ** 64 - 1)).count("1") <= limit for g, j, q, *_ in known)
                if n:
                    score[i] = n
            if score:
                best = min(score, key=lambda i: (-score[i], i))
                if score[best] >= -(-len(mine) // 2):
                    want[p, s] = (best, score[best])
        got = reposts.repost_by_hash(
            spark.createDataFrame([(*x[:5], at(x[5])) for x in new], "post_id long, segment_idx int, phash long, seller string, "
                                  "owner string, ref_time timestamp"),
            spark.createDataFrame([(*x[:5], at(x[5])) for x in known], "phash long, listing_id long, post_id long, seller string, "
                                  "owner string, last_seen timestamp"), max_distance=most, cross_distance=cross)
        assert {(r["post_id"], r["segment_idx"]): (r["listing_id"], r["matched"]) for r in got.collect()} == want and want
