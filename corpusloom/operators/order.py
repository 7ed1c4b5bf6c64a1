"""Order statistics without a task that holds a group or all rows: rows are dealt by ranges of their order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.session import stored


def numbered(df: DataFrame, order: list[Column], by: list[str] = (), name: str = "rank") -> DataFrame:
    """``df`` with the 1-based place of each row within its group ``by``, in ``order`` (which should leave no ties), and ``name``_of, the group's rows.

    Rows are dealt by sampled ranges of (group, order), so that a group of any size spreads over tasks, and sorted
    within them. A row's place is its number within its range, plus the rows of its group in earlier ranges; only
    the counts of groups by range are put in order.
    """
    keys = [F.col(f"`{k}`") for k in by]
    ranged = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    held = stored(ranged.withColumn("__at", F.monotonically_increasing_id()), "ranges").withColumn("__part", F.shiftright("__at", 33))
    parts = held.groupBy("__part", *by).agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    all_ = F.collect_list(F.struct("__part", "__n", "__first"))  # a group has at most as many as there are ranges
    before = lambda p: F.aggregate(F.filter("__all", lambda q: q["__part"] < p["__part"]), F.lit(0).cast("long"), lambda s, q: s + q["__n"])
    size = F.aggregate("__all", F.lit(0).cast("long"), lambda s, q: s + q["__n"])
    offsets = parts.groupBy(*by).agg(all_.alias("__all")).select(*by, size.alias("__size"), F.explode(F.transform("__all", lambda p: F.struct(p["__part"].alias("part"), (before(p) - p["__first"]).alias("move")))).alias("__o"))
    offsets = offsets.select(F.col("__o.part").alias("__in"), F.col("__o.move").alias("__move"), F.col("__size").alias(f"{name}_of"), *[F.col(f"`{k}`").alias(f"__by{i}") for i, k in enumerate(by)])
    same = F.col("__part") == F.col("__in")
    for i, k in enumerate(by):
        same = same & F.col(f"`{k}`").eqNullSafe(F.col(f"__by{i}"))
    return held.join(offsets, same).withColumn(name, F.col("__at") + F.col("__move") + 1).drop("__at", "__part", "__in", "__move", *[f"__by{i}" for i in range(len(by))])


def percentiles(df: DataFrame, value: str, points: dict[str, float], by: list[str] = (), linear: tuple[str, ...] = (), tie: str | None = None) -> DataFrame:
    """Exact order statistics of ``value`` within each group: sorted[int(p * (n - 1))], or between neighbours for the points named in ``linear``.

    ``tie``: a column that tells equal values apart, so that a common value spreads over ranges, too. Null values take no part.
    """
    ranked = numbered(df.where(F.col(value).isNotNull()), [F.col(value), *([F.col(tie)] if tie else [])], by)
    at = {k: F.lit(float(p)) * (F.col("rank_of") - 1) for k, p in points.items()}
    pick = lambda place, kind: F.max(F.when(F.col("rank") == place + 1, F.col(value).cast(kind)))

    def statistic(k: str) -> Column:
        low = F.floor(at[k])
        if k not in linear:
            return pick(low, df.schema[value].dataType).alias(k)
        share = F.max(at[k] - low)
        return (pick(low, "double") + (pick(F.ceil(at[k]), "double") - pick(low, "double")) * share).alias(k)

    wanted = [F.floor(x) + 1 for x in at.values()] + [F.ceil(at[k]) + 1 for k in linear]
    few = ranked.where(F.col("rank").isin(*wanted))
    return few.groupBy(*by).agg(*[statistic(k) for k in points])


def with_previous(ranked: DataFrame, by: list[str], columns: dict[str, str]) -> DataFrame:
    """``ranked`` (see numbered) with columns of the row before it in its group, null at the first: a join by place, so that a group spreads over tasks."""
    before = ranked.select(*[F.col(f"`{k}`").alias(f"__b{i}") for i, k in enumerate(by)], (F.col("rank") + 1).alias("__next"), *[F.col(f"`{c}`").alias(new) for c, new in columns.items()])
    same = F.col("rank") == F.col("__next")
    for i, k in enumerate(by):
        same = same & F.col(f"`{k}`").eqNullSafe(F.col(f"__b{i}"))
    return ranked.join(before, same, "left").drop("__next", *[f"__b{i}" for i in range(len(by))])


def running_sum(ranked: DataFrame, value: Column, by: list[str], name: str, block: int = 4096) -> DataFrame:
    """``ranked`` with the sum of ``value`` up to each row of its group: within blocks of places, plus the sums of earlier blocks."""
    keys = [F.col(f"`{k}`") for k in by]
    rows = ranked.withColumn("__v", value).withColumn("__block", F.floor((F.col("rank") - 1) / block))
    blocks = rows.groupBy(*by, "__block").agg(F.sum("__v").alias("__sum"))
    before = F.sum("__sum").over(Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1))
    starts = blocks.select(*[k.alias(f"__b{i}") for i, k in enumerate(keys)], F.col("__block").alias("__of"), F.coalesce(before, F.lit(0)).alias("__start"))
    same = F.col("__block") == F.col("__of")
    for i, k in enumerate(keys):
        same = same & k.eqNullSafe(F.col(f"__b{i}"))
    within = F.sum("__v").over(Window.partitionBy(*keys, "__block").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("__in", within).join(starts, same).withColumn(name, F.col("__start") + F.col("__in")).drop("__v", "__block", "__in", "__of", "__start", *[f"__b{i}" for i in range(len(by))])
