"""Live albums against the batch rule over several triggers, the cap on open ones, arrival time and late messages."""

import time

from pyspark.sql import functions as F

from bazaarlens.operators import sessions as op
from bazaarlens.plans import sessions as plans
from bazaarlens.session import fresh_path
from bazaarlens.streaming import albums, jobs

SCHEMA = "chat long, sender long, key long, ms long, kind string, bytes long, missing boolean"


def stream_of(spark, batches):
    """One file and one trigger per batch."""
    path = fresh_path(spark, "messages")
    for rows in batches:
        rows.coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)  # files are taken by their time
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def messages(spark, rows):
    return spark.createDataFrame([(1, s, k, ms, kind, 1, False) for s, k, ms, kind in rows], SCHEMA)


def test_many_triggers_equal_the_batch(spark):
    albums.use_rocksdb(spark)
    timed = plans.timed_messages(spark, "/root/testdata/sf0.001")
    line = plans.sender_line()
    numbered = op.number_albums(timed, line, plans.RULES)
    want = {(r["album_key"], r["n_messages"], r["n_images"], r["usable"]) for r in op.album_table(numbered, line.order).collect()}
    rows = timed.select("chat", "sender", "key", F.floor(F.col("ts_us") / 1000).alias("ms"), "kind", "bytes", "missing")
    low, high = rows.agg(F.min("ms"), F.max("ms")).first()
    step = (high - low) // 3 + 1
    ordered = [rows.where(F.floor((F.col("ms") - low) / step) == i) for i in range(3)]
    path = jobs.run_albums(spark, stream_of(spark, ordered), 4, rules=plans.RULES, max_open=10 ** 6)
    got = spark.read.parquet(path)
    closed = got.where("record = 'album'")
    assert {(r["album_key"], r["n_messages"], r["n_images"], r["usable"]) for r in closed.collect()} == want
    assert closed.count() == len(want) and not got.where("record = 'late'").count()


def test_oldest_goes_and_late_ones_are_listed(spark):
    albums.use_rocksdb(spark)
    first = messages(spark, [(s, s, 1000 + s, "image") for s in range(51)])
    second = messages(spark, [(3, 100, 500_000, "image"), (3, 101, 1_000, "image"), (3, 100, 500_000, "image")])
    third = messages(spark, [(3, 102, 500, "image")])
    path = fresh_path(spark, "out")
    stream = albums.stream_albums(stream_of(spark, [first, second, third]), shards=1)
    spark.conf.set(jobs.NO_DATA, "false")
    (stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", fresh_path(spark, "state"))
     .trigger(availableNow=True).start().awaitTermination(90))
    spark.conf.set(jobs.NO_DATA, "true")
    got = [(r["record"], r["sender"], list(r["keys"])) for r in spark.read.schema(albums.OUTPUT).parquet(path).collect()]
    # the 51st sender pushes out the first; message 101 still fits album 3, message 100 does not and closes it
    # and 102 lies behind it
    assert sorted(got) == [("album", 0, [0]), ("album", 3, [3, 101]), ("late", 3, [102])]


def test_quiet_chat_closes_by_the_clock(spark):
    albums.use_rocksdb(spark)
    rules = op.AlbumRules(idle_s=1, span_s=600)
    stream = albums.stream_albums(stream_of(spark, [messages(spark, [(1, 1, 0, "image"), (1, 2, 10, "text")])]), rules,
                                  shards=1, grace_ms=500)
    path = fresh_path(spark, "out")
    query = (stream.writeStream.format("parquet").option("path", path).option(
        "checkpointLocation", fresh_path(spark, "state")).trigger(processingTime="1 second").start())
    until = time.time() + 60
    try:
        while time.time() < until:
            time.sleep(1)
            rows = spark.read.schema(albums.OUTPUT).parquet(path).collect() if query.lastProgress else []
            if rows:
                break
    finally:
        query.stop()
    assert [(r["record"], r["keys"]) for r in rows] == [("album", [1, 2])]
