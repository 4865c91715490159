"""Session settings for tests and the bench, and the shared folder used to cut lineage or hand over tables."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(cpus: int | str = 8, app: str = "bazaarlens") -> SparkSession:
    """A local session. On a cluster the caller brings its own session and settings."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config(CHECKPOINT_CONF, os.environ.get("SPARK_CHECKPOINT_DIR", "/tmp/bazaarlens-shared"))
        .config("spark.sql.shuffle.partitions", str(cpus if str(cpus).isdigit() else 8))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.streaming.stateStore.providerClass",
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it. `build_session` sets one for local runs."""
    named = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getCheckpointDir()
    if not named:
        raise RuntimeError(f"{CHECKPOINT_CONF} must name a folder that driver and executors share")
    return named


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder for one run's table."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to a new table in the shared folder and read them from there: computed once, under adaptive
    execution, and a lost executor never replays the history of an iteration."""
    path = fresh_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
