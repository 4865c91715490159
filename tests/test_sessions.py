"""Albums and quotas: typed cases, both plans of the ordered helpers, and the live stream against the batch."""

import random

import pytest
from pyspark.sql import functions as F

from bazaarlens.operators import chunked, jumps
from bazaarlens.operators import sessions as op
from bazaarlens.operators.chunked import Line

MB = 1024 * 1024
CASES = {  # messages: key@second/sender, T = text, ! = missing; expected albums of usable photos
    "one photo": ("a@0", ["a"]), "burst": ("a@0 b@1 c@2", ["abc"]), "gap of 61 s splits": ("a@0 b@61", ["a", "b"]),
    "gap of 60 s joins": ("a@0 b@60", ["ab"]), "span cap": (" ".join(f"{c}@{20 * i}" for i, c in enumerate("abcdefghijk")),
                                                            ["abcdefghij", "k"]),
    "two senders": ("a@0/x b@1/y c@2/x d@3/y", ["ac", "bd"]), "text before": ("tT@0 a@10 b@12", ["tab"]),
    "text extends": ("a@0 tT@50 b@100", ["atb"]), "text only dropped": ("tT@0 uT@5", []),
    "late text dropped": ("a@0 tT@300", ["a"]), "all missing dropped": ("a!@0 b!@1", []),
    "part missing kept": ("a!@0 b@1", ["ab"]), "same key once": ("a@0 a@0 b@1", ["ab"]),
    "order of first message": ("a@0/x b@5/y c@50/x d@100/x", ["acd", "b"]),
}


def read(text, name):
    rows = []
    for place, word in enumerate(text.split()):
        head, _, rest = word.partition("@")
        second, _, sender = rest.partition("/")
        rows.append((name, head[0], sender or "s", float(second), place, "text" if "T" in head else "image", "!" in head, 0))
    return rows


SCHEMA = "chat string, key string, sender string, ts_s double, place long, kind string, missing boolean, bytes long"


def albums(df, rules=op.AlbumRules(), chunk=3):
    line = op.sender_line([F.col("place")], F.floor(F.col("place") / chunk))
    rows = op.group_albums(df, line, rules).select("chat", "sender", "album_key", "key", "place").collect()
    found = {}
    for r in sorted(rows, key=lambda r: r.place):
        found.setdefault((r.chat, r.sender, r.album_key), []).append(r.key)
    return {chat: ["".join(v) for (c, _, _), v in found.items() if c == chat] for chat in {r.chat for r in rows}}


@pytest.mark.parametrize("chunk", [3, 1000])
def test_typed_albums(spark, chunk):
    df = spark.createDataFrame([r for n, (text, _) in CASES.items() for r in read(text, n)], SCHEMA)
    got = albums(df, chunk=chunk)
    assert {n: got.get(n, []) for n in CASES} == {n: want for n, (_, want) in CASES.items()}


def test_size_caps(spark):
    burst = [("c", f"{i:02d}", "s", float(i), i, "image", False, 0) for i in range(31)]
    df = spark.createDataFrame(burst, SCHEMA)
    line = op.sender_line([F.col("place")], F.floor(F.col("place") / 10))
    sizes = op.group_albums(df, line).groupBy("album_key").count().orderBy("album_key").collect()
    assert [s["count"] for s in sizes] == [30, 1]
    heavy = spark.createDataFrame([("c", k, "s", float(i), i, "image", False, 25 * MB) for i, k in enumerate("abc")], SCHEMA)
    assert albums(heavy) == {"c": ["ab", "c"]}


def naive(rows, rules):
    """The rule message by message, for random histories."""
    opened, out = {}, []
    for key, sender, ts, kind, size in rows:
        a = opened.get(sender)
        fits = a and ts - a["last"] <= rules.idle_s and ts - a["first"] <= rules.span_s and (
            kind == "text" or (a["n"] < rules.max_images and a["bytes"] + size <= rules.max_bytes))
        if not fits:
            a = opened[sender] = {"first": ts, "last": ts, "n": 0, "bytes": 0, "keys": []}
            out.append(a)
        a["keys"].append(key)
        a["last"] = max(a["last"], ts)
        if kind == "image":
            a["n"], a["bytes"] = a["n"] + 1, a["bytes"] + size
    return {k: a["keys"][0] for a in out if a["n"] for k in a["keys"]}


@pytest.mark.parametrize("chunk", [50, 10 ** 6])
def test_random_histories(spark, chunk):
    rng = random.Random(3)
    rows, at = [], 0.0
    for i in range(600):  # arrival order is not always time order
        at += rng.choice([0, 5, 20, 40, 70])
        rows.append((f"k{i:03d}", rng.choice("xxxy"), max(0.0, at - rng.choice([0, 0, 30])),
                     rng.choice(["image", "image", "text"]), rng.randrange(30 * MB)))
    rules = op.AlbumRules(max_images=4)
    df = spark.createDataFrame([("c", k, s, ts, i, kind, False, b) for i, (k, s, ts, kind, b) in enumerate(rows)], SCHEMA)
    line = op.sender_line([F.col("place")], F.floor(F.col("place") / chunk))
    got = {r.key: r.album_key for r in op.group_albums(df, line, rules).select("key", "album_key").collect()}
    assert got == naive(rows, rules)


def test_sliding_quota(spark):
    rng = random.Random(5)
    times, at = [], 0
    for _ in range(500):
        at += rng.choice([1, 2, 2, 30, 90])
        times.append(at)
    want, held = [], []
    for x in times:
        held = [h for h in held if h > x - 60]
        want.append((len(held) < 5, 0 if len(held) < 5 else max(1, held[0] + 60 - x)))
        if len(held) < 5:
            held.append(x)
    df = spark.createDataFrame([("k", i, x * op.MICROS) for i, x in enumerate(times)], "key string, i long, at long")
    line = Line(["key"], [F.col("at"), F.col("i")], F.floor(F.col("at") / (100 * op.MICROS)))
    got = op.sliding_quota(df, line, "at", limit=5, window_s=60).orderBy("i").collect()
    assert [(g.admitted, g.retry_after) for g in got] == want


def test_chunks_give_what_one_chunk_gives(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", None]), i, rng.choice([None, i * 3 % 7])) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, i long, v long")
    for helper in (lambda d, n: chunked.running_sum(d, n, F.col("v"), "o"), lambda d, n: chunked.row_number(d, n, "o"),
                   lambda d, n: chunked.prefix_max(d, n, F.col("v"), "o"),
                   lambda d, n: chunked.previous(d, n, F.col("v"), "o"),
                   lambda d, n: chunked.previous(d, n, F.col("v"), "o", skip_nulls=True),
                   lambda d, n: chunked.previous(d, n.reversed(), F.col("v"), "o", skip_nulls=True)):
        plain, hot = (sorted((r.i, r.o) for r in helper(df, Line(["k"], [F.col("i")], F.floor(F.col("i") / h)))
                             .collect()) for h in (10 ** 6, 11))
        assert plain == hot


def test_columns_pass_whole(spark):
    """Large numbers next to nulls come out as they went in, and one long run is cut right."""
    big = 2 ** 53 + 1
    rows = [("c", f"{i:05d}", None, i * 0.5, i, "image", i % 9 == 0, 1, big if i % 2 else None) for i in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA + ", note long")
    line = op.sender_line([F.col("place")], F.floor(F.col("place") / 100))
    got = op.group_albums(df, line).orderBy("place").collect()
    assert [(r.key, r.note) for r in got] == [(r[1], r[8]) for r in rows]
    assert [int(r.album_key) for r in got] == [i // 30 * 30 for i in range(3000)]
    hits = spark.createDataFrame([("k", i, i * op.MICROS, big if i % 2 else None) for i in range(200)],
                                 "key string, i long, at long, note long")
    judged = op.sliding_quota(hits, Line(["key"], [F.col("at")], F.floor(F.col("at") / 10 ** 8)), "at", limit=5, window_s=60)
    assert [r.note for r in judged.orderBy("i").collect()] == [big if i % 2 else None for i in range(200)]


def test_first_beyond_and_reached(spark):
    rng = random.Random(8)
    n = 9000  # three levels of the tree
    v = [rng.choice([rng.randrange(50), i // 3, None]) for i in range(n)]
    points = spark.createDataFrame([("r", i, x) for i, x in enumerate(v)] + [("s", 0, 5)], "run string, pos long, v long")
    starts = points.select("run", "pos", F.col("pos").cast("long").alias("base"))
    for most, or_equal in ((-2900, False), (5, True)):
        got = {(r.run, r.pos): r.found for r in jumps.first_beyond(
            points, starts, ["run"], [jumps.Limit("v", "base", most, or_equal)]).collect()}
        assert len(got) == n + 1 and got["s", 0] is None
        for i in [*range(0, n, 97), n - 1]:
            passed = lambda j: v[j] is not None and (v[j] - i > most or (or_equal and v[j] - i == most))
            assert got["r", i] == next((j for j in range(i + 1, n) if passed(j)), None)
    hops = spark.createDataFrame([("r", i, i + 1 + i % 7 if i + 1 + i % 7 < n else None) for i in range(n)],
                                 "run string, pos long, found long")
    want, at = set(), 0
    while at < n:
        want.add(at)
        at += 1 + at % 7
    assert {r.pos for r in jumps.reached(hops, ["run"]).collect()} == want
