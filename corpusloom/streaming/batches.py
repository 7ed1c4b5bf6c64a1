"""A split read in micro-batches, with progress events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def split_batches(
    spark: SparkSession,
    path: str,
    each: Callable[[DataFrame, int], None],
    work: str,
    needed: tuple[str, ...] = ("article", "abstract"),
    files_per_batch: int = 1,
    progress: Callable[[str, int], None] = lambda kind, batch: None,
) -> int:
    """Call ``each`` on every micro-batch of the Parquet folder ``path``; returns the number of batches.

    Rows where a ``needed`` column is null or empty are left out. The checkpoint under ``work`` lets a broken
    run go on after its last whole batch. ``progress`` gets ("start", 0), ("running", n) and ("done", n) around
    each batch, and ("finished", number of batches).
    """
    count = 0

    def batch(df: DataFrame, n: int) -> None:
        nonlocal count
        progress("running", n)
        each(df, n)
        progress("done", n)
        count += 1

    progress("start", 0)
    rows = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    for c in needed:
        rows = rows.where(F.coalesce(F.col(c).cast("string"), F.lit("")) != "")
    rows.writeStream.foreachBatch(batch).option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    progress("finished", count)
    return count
