"""Shared helpers: the shared work folder, raw text access in Arrow batches, connected components."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset, the folder set on the context, or a temporary one if Spark runs in one
    process (as in tests); on a cluster an unset folder is an error, as executors would not share it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if found:
        if held.isEmpty():
            spark.sparkContext.setCheckpointDir(found)
        return found
    if held.isEmpty():
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(Path(tempfile.mkdtemp(prefix="corpusloom-")).as_uri())
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
    return held.get()


class Scratch:
    """Tables written to the shared folder, so that a lost executor costs a read, and deleted when they are superseded."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written as Parquet and read back; lineage ends there."""
        path = f"{work_dir(self.spark).rstrip('/')}/corpusloom/{name}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete these tables, or all; nothing that still reads them may be run after."""
        for key in [id(t) for t in tables] if tables else list(self.paths):
            path, _ = self.paths.pop(key, (None, None))
            if path:
                at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
        if not tables:
            self.sweep()

    def sweep(self) -> None:
        """Let the context cleaner remove the shuffle files of plans that nothing refers to any more."""
        gc.collect()
        self.spark._jvm.System.gc()


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back; for small tables that a lazy result still reads."""
    return Scratch(df.sparkSession).stored(df, name)


def raw_texts(column: pa.Array | pa.ChunkedArray) -> Iterator[bytes]:
    """UTF-8 bytes of each value, null as empty, without making Python strings."""
    if isinstance(column, pa.ChunkedArray):
        for chunk in column.chunks:
            yield from raw_texts(chunk)
        return
    if not len(column):
        return
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1]
    held = memoryview(data) if data is not None else memoryview(b"")
    valid = None if not column.null_count else column.is_valid().to_numpy(zero_copy_only=False)
    for i in range(len(column)):
        yield b"" if valid is not None and not valid[i] else bytes(held[ends[i] : ends[i + 1]])


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60, scratch: Scratch | None = None) -> DataFrame:
    """Distributed union-find over undirected ``edges``: (node, root), root the smallest node reachable.

    Each round takes the smallest root among a node and its neighbours (aggregated before the
    shuffle), then jumps to that root's own root; the state is written to the shared folder each
    round and the one before it deleted. Only whether any node changed reaches the driver. Nulls
    and loops in ``edges`` are ignored. The result stays in ``scratch`` if one is given.
    """
    keep = scratch or Scratch(edges.sparkSession)
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    both = keep.stored(e.union(e.select("b", "a")).distinct(), "edges")
    state = keep.stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("low", "node").alias("root")), "roots")
    for _ in range(most_rounds):
        near = both.join(state, both["b"] == state["node"]).groupBy(F.col("a").alias("n")).agg(F.min("root").alias("near"))
        step = state.join(near, state["node"] == near["n"], "left").select("node", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        up = state.select(F.col("node").alias("up"), F.col("root").alias("up_root"))
        new = keep.stored(step.join(up, step["root"] == up["up"], "left").select("node", "was", F.least("root", "up_root").alias("root")), "roots")
        keep.drop(state)
        state = new
        if not new.where(F.col("root") != F.col("was")).limit(1).count():
            keep.drop(both)
            return new.select("node", "root")
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def weight(df: DataFrame) -> int:
    """Bytes that the rows of ``df`` (a stored table) take in memory, roughly: 16 a row, 16 a value, and the data of strings and arrays."""
    size = F.lit(16 + 16 * len(df.columns)).cast("long")
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            size = size + F.coalesce(F.octet_length(c), F.lit(0))
        elif isinstance(f.dataType, T.ArrayType):
            size = size + F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)) * 8
    return df.agg(F.sum(size)).first()[0] or 0


def join_checked(big: DataFrame, small: DataFrame, on, how: str, most_bytes: int = 64 << 20) -> DataFrame:
    """Join; ``small`` (a stored table) is broadcast only if it weighs at most ``most_bytes``, else both sides are shuffled."""
    return big.join(F.broadcast(small) if weight(small) <= most_bytes else small, on, how)


def without_ids(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` without the rows whose id is in the single column of ``gone`` (a stored table); null ids stay. Column names may be any."""
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    return join_checked(plain, gone.toDF("gone"), F.col(f"c{names.index(id_col)}") == F.col("gone"), "left_anti").toDF(*names)
