"""Mixing sources to target weights, with DataFrame functions only.

Each document gets a hash-random key. Within a source, documents are range-sorted by key in
``buckets`` equal ranges of the key space; ranges are even whatever the source's share, so a hot
source is split like any other. Prefix sums of sizes are taken in two levels: of the ranges'
totals within the source (at most ``buckets`` rows a source), and within each range. A source is
cut at its exact budget: whole passes first, then documents in key order, the last one in part.

Defined results: a null text has size 0 and is kept with taken 0. Sources rank by code point,
null last, and weights repeat along that order. Repeated rows each count. Ties of the key are
broken by id, size and text digest; rows equal in all of these are interchangeable. A target is
rounded down to whole words. The table of sources (one row each) is small by nature and is the
only thing ranked in a single window. Columns other than those named are carried by the caller.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WORD = "[^\\\\x20\\\\x09-\\\\x0D]+"


def n_words(text: str) -> Column:
    """Number of runs of anything but ASCII white space; null: 0."""
    return F.coalesce(F.expr(f"regexp_count({text}, '{WORD}')"), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target): ``share`` of all words split by weight; no target above ``most`` times its source.

    Resharing the excess until none is above ends where target = min(cap, weight * level) with one
    common level; sources in order of cap / weight fill up first, which gives the level from two
    running sums.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1, F.lit(len(weights))).cast("int") + 1)
    t = sizes.withColumn("weight", w).withColumn("cap", F.lit(most) * F.col("source_size"))
    t = t.withColumn("fill", F.col("cap") / F.col("weight"))
    by = Window.orderBy("fill", F.col("source").isNull(), "source")
    before, every = by.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    t = t.withColumn("level", (F.lit(share) * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    # along that order the level rises while sources fill up and falls after, so the common level is the largest
    return t.select("source", "source_size", F.least("cap", F.col("weight") * F.max("level").over(every)).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: str = "mix", buckets: int = 1024, **shares) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken): how many words of each document the mix takes."""
    if not 1 <= buckets <= 4096:
        raise ValueError("buckets must be between 1 and 4096")
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(f"`{text_col}`").alias("size"), key.alias("key"), F.xxhash64(text_col).alias("tie"))
    # the key's first 12 bits pick its range
    d = d.withColumn("bucket", F.floor(F.conv(F.substring("key", 1, 3), 16, 10).cast("int") * buckets / 4096).cast("int"))
    ranges = d.groupBy("source", "bucket").agg(F.sum("size").alias("range_size"))
    up = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    goal = targets(ranges.groupBy("source").agg(F.sum("range_size").alias("source_size")), **shares)
    starts = ranges.withColumn("start", F.coalesce(F.sum("range_size").over(up), F.lit(0)))
    starts = starts.join(goal, starts["source"].eqNullSafe(goal["source"])).select(starts["source"].alias("s"), F.col("bucket").alias("b"), "start", "source_size", "target")
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("prior", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    d = d.join(starts, d["source"].eqNullSafe(starts["s"]) & (d["bucket"] == starts["b"]))
    budget = F.floor("target")
    passes = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    rest = budget - passes * F.col("source_size") - F.col("start") - F.col("prior")
    taken = (passes * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))).cast("long")
    return d.select("doc_id", "source", "size", F.col("source_size").cast("long").alias("source_size"), "target", taken.alias("taken"))


ORACLE = """
WITH d AS (SELECT doc_id, source, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS key, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
f AS (SELECT *, cap / weight AS fill FROM w),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY fill, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY fill, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM f),
t AS (SELECT source, source_size, least(cap, weight * (SELECT max(level) FROM l)) AS target FROM l),
p AS (SELECT d.*, t.source_size, t.target, floor(t.target)::BIGINT AS budget,
  coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS prior
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS passes FROM p)
SELECT doc_id, source, size, source_size, target, (passes * size + greatest(0, least(size, budget - passes * source_size - prior)))::BIGINT AS taken FROM e
"""
