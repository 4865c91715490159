"""A file per name, in shards, and listed by a task per shard."""

import os
from pathlib import Path

from pyspark.sql import functions as F

from bazaarlens.session import fresh_path
from bazaarlens.sources import files


def test_every_name_is_one_file_in_a_shard(spark):
    names = [f"n {i}=/é.html" for i in range(300)]
    rows = spark.createDataFrame([(n, "x" * i) for i, n in enumerate(names)] + [(names[5], "again")], "name string, value string")
    path = fresh_path(spark, "media-test")
    files.write_each(rows, "name", path, shards=8)
    listed = files.list_media(spark, path).select("path", "length").collect()
    assert len(listed) == 300 and sum(r["length"] for r in listed) == sum(range(300)) + 300 + 6
    tops = {r["path"].split(path.rstrip("/").rsplit("/", 1)[1] + "/")[1].split("/")[0] for r in listed}
    assert tops == {f"shard={k}" for k in range(8)}  # a listing is a task per folder at the top
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    assert read.where(F.col("length") == 5 + 1 + 6).count() == 2  # the repeated name, and the text of 11 letters


def test_tasks_write_the_files_themselves(spark):
    """Spark's writer moves every file into place and leaves a checksum beside it."""
    rows = [("a b=c/d", "x"), ("a b=c/d", "y"), (None, "z"), ("", "w"), ("é%:", "q"), ("n", None), ("Ab{c}", "2")]
    path = fresh_path(spark, "media-odd")
    files.write_each(spark.createDataFrame(rows, "name string, value string"), "name", path, shards=8)
    root = path.removeprefix("file://")
    found = sorted(f"{Path(d).name}/{f}" for d, _, names in os.walk(root) for f in names if "shard=" in d)
    none = "name=__HIVE_DEFAULT_PARTITION__"
    assert found == sorted(f"{d}/part.txt" for d in (
        "name=a b%3Dc%2Fd", none, none, "name=é%25%3A", "name=n", "name=Ab%7Bc}"))
    back = sorted(((r["name"], r["value"]) for r in spark.read.text(path).collect()), key=str)
    assert back == sorted(((n or None, v or "") for n, v in rows), key=str)
    assert files.list_media(spark, path).count() == 6
