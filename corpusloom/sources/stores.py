"""Stores: vectors by document, benchmark results, resumable runs, tables kept for a time."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VECTORS = "document_id string, chunk_ids array<string>, embeddings array<array<double>>, metadatas array<map<string, string>>"
RESULT = "dataset_name string, model_name string, samples_evaluated long, timestamp string, comparison_all_algorithms array<string>, key_findings array<string>"


def files(spark: SparkSession, path: str):
    """(file system, path) of a folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def write_vectors(chunks: DataFrame, path: str) -> None:
    """``chunks`` (document_id, chunk_id, vector, metadata map) as JSON lines, one object a document."""
    of = F.sort_array(F.collect_list(F.struct("chunk_id", "vector", F.map_entries("metadata").alias("m"))))
    by = chunks.groupBy("document_id").agg(of.alias("c"))
    by.select("document_id", F.col("c.chunk_id").alias("chunk_ids"), F.col("c.vector").alias("embeddings"), F.transform("c.m", F.map_from_entries).alias("metadatas")).write.mode("overwrite").json(path)


def read_vectors(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    """(document_id, chunk_id, vector, metadata); ``lines``: an object a line, else one object a file (``*.vectors.json``). Chunks without metadata have null there."""
    r = spark.read.schema(VECTORS).option("multiLine", str(not lines).lower())
    held = (r if lines else r.option("pathGlobFilter", "*.vectors.json")).json(path)
    each = held.select("document_id", F.posexplode("chunk_ids").alias("i", "chunk_id"), "embeddings", "metadatas")
    return each.select("document_id", "chunk_id", F.get("embeddings", F.col("i")).alias("vector"), F.get("metadatas", F.col("i")).alias("metadata"))


def read_benchmarks(spark: SparkSession, path: str) -> DataFrame:
    """(filename, dataset, model, samples, timestamp, comparison, key_findings, modified): one JSON object a file, its ``aggregate`` if it has one; files that are no JSON are passed over; newest first."""
    names = [c.split()[0] for c in RESULT.split(", ")]
    r = spark.read.schema(f"{RESULT}, aggregate struct<{RESULT.replace(' ', ': ').replace(',:', ',')}>").option("multiLine", "true").option("mode", "DROPMALFORMED").option("pathGlobFilter", "*.json")
    df = r.json(path).withColumns({"filename": F.col("_metadata.file_name"), "modified": F.col("_metadata.file_modification_time")})
    pick = [F.when(F.col("aggregate").isNotNull(), F.col(f"aggregate.{c}")).otherwise(F.col(c)).alias(n) for c, n in zip(names, ("dataset", "model", "samples", "timestamp", "comparison", "key_findings"))]
    return df.select("filename", *pick, "modified").orderBy(F.desc("modified"), "filename")


def resume(cells: DataFrame, models: dict[str, Callable[[DataFrame], DataFrame]], path: str, key: str = "sample_id") -> DataFrame:
    """Results of every model on ``cells``, kept as Parquet under ``path``; what an earlier, broken run has written there is not run again.

    A model takes and returns rows with the column ``key``. Each model's rows are one write, so they are kept when a later model fails.
    """
    spark = cells.sparkSession
    out = None
    for name, run in models.items():
        at = f"{path}/{name}"
        fs, folder = files(spark, f"{at}/_SUCCESS")
        todo = cells
        if fs.exists(folder):
            todo = cells.join(spark.read.parquet(at).select(key).distinct(), key, "left_anti")
        run(todo).write.mode("append").parquet(at)
        got = spark.read.parquet(at).withColumn("model", F.lit(name))
        out = got if out is None else out.unionByName(got, allowMissingColumns=True)
    return out


class TableCache:
    """Tables kept under ``root`` for ``ttl`` seconds by key."""

    def __init__(self, spark: SparkSession, root: str, ttl: float, clock: Callable[[], float] = time.time):
        self.spark, self.root, self.ttl, self.clock = spark, root.rstrip("/"), ttl, clock

    def folder(self, key: str) -> str:
        return f"{self.root}/{hashlib.md5(key.encode()).hexdigest()}"

    def get(self, key: str, build: Callable[[], DataFrame]) -> DataFrame:
        """The table of ``key`` if it is younger than the time to live, else ``build()``'s, written for the next call."""
        fs, folder = files(self.spark, self.folder(key))
        now = int(self.clock() * 1000)
        kept = [s.getPath() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        done = [p for p in kept if fs.exists(files(self.spark, f"{p.toString()}/_SUCCESS")[1])]
        fresh = [p for p in done if now - int(p.getName()) < self.ttl * 1000]
        if fresh:
            return self.spark.read.parquet(max(fresh, key=lambda p: int(p.getName())).toString())
        made = f"{self.folder(key)}/{now}"
        build().write.parquet(made)
        for p in done:
            fs.delete(p, True)
        return self.spark.read.parquet(made)

    def drop(self, key: str) -> None:
        fs, folder = files(self.spark, self.folder(key))
        fs.delete(folder, True)
