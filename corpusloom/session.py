"""Spark session factory and table access shared by queries, bench and tests."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "corpusloom") -> SparkSession:
    """A session with adaptive execution on, UTC and Arrow transfer."""
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.driver.memory", "8g")  # in local mode the driver is the executor, too
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table as a DataFrame; only Spark's reader touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its scan has fewer splits than there are, as a small file of one row group has; larger tables stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the one set on the context.

    Where neither is set, a temporary folder if Spark runs in one process; on a cluster an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if found or not held.isEmpty():
        return found or held.get()
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return Path(tempfile.mkdtemp(prefix="corpusloom-")).as_uri()


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once however often a plan reads it, and lineage ends there."""
    path = f"{work_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sql_over(build: Callable[..., str], *frames: DataFrame) -> DataFrame:
    """The statement that ``build`` makes of names for ``frames``; their views are gone once it is analysed."""
    spark = frames[0].sparkSession
    names = [f"frame_{uuid.uuid4().hex}" for _ in frames]
    for f, n in zip(frames, names):
        f.createOrReplaceTempView(n)
    try:
        return spark.sql(build(*names))
    finally:
        for n in names:
            spark.catalog.dropTempView(n)
