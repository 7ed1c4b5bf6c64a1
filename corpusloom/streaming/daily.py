"""Daily time series as a stream: watermarked daily windows over events; its final state equals the batch answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def daily(events: DataFrame, late: str = "2 days") -> DataFrame:
    """(day, event_type, n, total) by day of ``ts``; works on streams and on batches."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    by = events.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return by.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")


def stream_of(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """The Parquet file or folder ``path`` as a stream; all files in one batch unless told otherwise."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(at).isDirectory()
    source = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_trigger:
        source = source.option("maxFilesPerTrigger", files_per_trigger)
    if folder:
        return source.parquet(path)
    return source.option("pathGlobFilter", at.getName()).parquet(at.getParent().toString())  # a stream reads folders: the file's, and of it that file alone


def run_daily_stream(spark: SparkSession, path: str, work: str, files_per_trigger: int = 1, late: str = "2 days") -> DataFrame:
    """Run the stream over the Parquet file or folder ``path`` until all is read.

    In update mode: each micro-batch hands on only the days that it changed, which replace their earlier rows under
    ``work``; days that the watermark has passed leave the state, and rows later than ``late`` are dropped. Nothing is
    held on the driver, and the checkpoint beside it lets a broken run go on.
    """
    series = daily(stream_of(spark, path, files_per_trigger), late)

    def replace(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{work}/series/batch={batch}")

    series.writeStream.outputMode("update").foreachBatch(replace).option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in series.schema)}, batch long").parquet(f"{work}/series")
    last = F.max_by(F.struct(*series.columns), "batch").alias("r")
    return rows.groupBy("day", "event_type").agg(last).select("r.*")
