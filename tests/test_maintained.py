"""Purges, medians and long messages against plain Python."""

import random
import statistics

from pyspark.sql import functions as F

from bazaarlens.operators import chat_export, chunked, maintenance, reports


def test_median(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, rng.randrange(-5000, 5000), 7])) for _ in range(900)] + [("c", None), ("d", 5)]
    df = spark.createDataFrame(rows, "k string, v long")
    want = {}
    for k, v in rows:
        if v is not None:
            want.setdefault(k, []).append(v)
    got = {r["k"]: r["median"] for r in reports.exact_median(df, "k", "v", width=100).collect()}
    assert got == {k: statistics.median(v) for k, v in want.items()}
    assert chunked.joined(df, df.limit(0).select("k", F.lit(1).alias("x")), ["k"]).count() == len(rows)


def test_cascade(spark):
    """A purged post takes its listing, the listing other posts' sightings of it and its matches; a kept one stays."""
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    tables = {
        "posts": frame([(1, "demo_upload", 0), (2, "demo_upload", 5), (3, "chat", 0)], "post_id long, source string, at int"),
        "wishlists": frame([(7, "local", 0, None), (8, "u1", 0, "s8"), (9, "u1", 5, "s9")],
                           "wishlist_id long, owner string, at int, ref_image_sha string"),
        "images": frame([(1, "s1"), (2, "s2"), (1, "s2")], "post_id long, sha256 string"),
        "listings": frame([(10, 1), (30, 3)], "listing_id long, post_id long"),
        "sightings": frame([(10, 1), (10, 3), (30, 3), (30, 1)], "listing_id long, post_id long"),
        "matches": frame([(7, 10), (7, 30), (8, 30), (9, 30)], "wishlist_id long, listing_id long"),
        "blobs": frame([("s1", 0), ("s2", 0), ("s8", 0), ("s9", 0), ("new", 5)], "sha256 string, at int")}
    now = F.lit("2024-01-03 00:00:00").cast("timestamp")
    age = F.when(F.col("at") == 5, now - F.expr("interval 1 hour")).otherwise(now - F.expr("interval 2 days"))
    tables = {n: df.withColumn("created_at", age).drop("at") if "at" in df.columns else df for n, df in tables.items()}
    got = {n: sorted(map(tuple, df.select(*[c for c in tables[n].columns if c not in ("created_at", "source", "owner", "ref_image_sha")]).collect()))
           for n, df in maintenance.ttl_purge(tables, now).items()}
    assert got == {"posts": [(2,), (3,)], "wishlists": [(7,), (9,)], "images": [(2, "s2")], "listings": [(30, 3)],
                   "sightings": [(30, 3)], "matches": [(7, 30), (9, 30)], "blobs": [("new",), ("s2",), ("s9",)]}


def test_long_message_in_parts(spark):
    lines = ["14/03/24, 13:00 - One: start"] + [f"line {i}" for i in range(1, 1000)] + ["14/03/24, 13:01 - Two: end"]
    raw = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file string, line_no long, line string")
    heads = chat_export.parse_chat_headers(raw)
    rows = chat_export.assemble_messages(heads, chat_export.infer_chat_format(heads), "UTC", part_lines=64)
    got = sorted(((r["line_no"], r["part"], r["sender"], r["body"]) for r in rows.collect()))
    assert [(n, p, s) for n, p, s, _ in got] == [(0, k, "One") for k in range(16)] + [(1000, 0, "Two")]
    assert "\n".join(b for _, _, s, b in got if s == "One") == "\n".join(["start", *lines[1:1000]])
