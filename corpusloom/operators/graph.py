"""Ranks of nodes by messages along edges, for many small graphs or one that no task could hold."""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import stored


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int = 100, tol: float = 1e-6, cut_every: int = 5) -> DataFrame:
    """(graph, node, rank) of weighted graphs: ``nodes`` (graph, node), ``edges`` (graph, src, dst, weight).

    rank = (1 - damping) / n + damping * sum over incoming edges of the source's rank times the edge's share of the
    source's outgoing weight; the weight of nodes without outgoing edges is lost; a graph without edges is uniform. A
    graph ends with the first round that moves its ranks by less than ``tol`` in sum, or after ``rounds``. Edges
    without positive weight are left out; repeated edges add up; edges of unknown nodes carry nothing.

    A round joins ranks to edges and adds up messages per node; the edges stay partitioned by their source, so only
    ranks and messages move. After ``cut_every`` rounds the ranks of those rounds are written, which cuts the lineage, and
    the graphs that have ended leave. Only whether any graph is left reaches the driver.
    """
    given = edges.where(F.col("weight") > 0).groupBy("graph", "src", "dst").agg(F.sum("weight").alias("weight"))
    out = given.groupBy(F.col("graph").alias("og"), F.col("src").alias("os")).agg(F.sum("weight").alias("out"))
    shares = given.join(out, (F.col("graph") == F.col("og")) & (F.col("src") == F.col("os"))).select(F.col("graph").alias("eg"), "src", "dst", (F.col("weight") / F.col("out")).alias("share"))
    shares = stored(shares, "edges").repartition("eg", "src").persist(StorageLevel.DISK_ONLY)
    distinct = nodes.select("graph", "node").distinct()
    linked = shares.select(F.col("eg").alias("g")).distinct().withColumn("linked", F.lit(True))
    sizes = distinct.groupBy(F.col("graph").alias("sg")).agg(F.count("*").alias("n")).join(linked, F.col("sg") == F.col("g"), "left")
    start = distinct.join(sizes, F.col("graph") == F.col("sg")).select("graph", "node", "n", F.col("linked").isNotNull().alias("linked"), (1 / F.col("n")).alias("r0"))
    start = stored(start, "ranks")
    done, live = [start.where(~F.col("linked")).select("graph", "node", F.col("r0").alias("rank"))], start.where("linked").drop("linked")
    for first in range(0, rounds, cut_every):
        many = min(cut_every, rounds - first)
        state = live
        for k in range(many):
            sent = shares.join(state.select(F.col("graph").alias("mg"), F.col("node").alias("mn"), F.col(f"r{k}").alias("r")), (F.col("eg") == F.col("mg")) & (F.col("src") == F.col("mn")))
            got = sent.groupBy(F.col("eg").alias("tg"), F.col("dst").alias("tn")).agg(F.sum(F.col("share") * F.col("r")).alias("got"))
            rank = (1 - damping) / F.col("n") + damping * F.coalesce("got", F.lit(0.0))
            state = state.join(got, (F.col("graph") == F.col("tg")) & (F.col("node") == F.col("tn")), "left").withColumn(f"r{k + 1}", rank).drop("tg", "tn", "got")
        state = stored(state, "ranks")
        moved = state.groupBy(F.col("graph").alias("dg")).agg(*[F.sum(F.abs(F.col(f"r{k + 1}") - F.col(f"r{k}"))).alias(f"d{k + 1}") for k in range(many)])
        ended = F.coalesce(*[F.when(F.col(f"d{k}") < tol, k) for k in range(1, many + 1)], *([F.lit(many)] if first + many == rounds else []))
        both = stored(state.join(moved.select("dg", ended.alias("ended")), F.col("graph") == F.col("dg")).drop("dg"), "ranks")
        final = reduce(lambda x, k: F.when(F.col("ended") == k, F.col(f"r{k}")).otherwise(x), range(1, many + 1), F.lit(None).cast("double"))
        done.append(both.where("ended IS NOT NULL").select("graph", "node", final.alias("rank")))
        live = both.where("ended IS NULL").select("graph", "node", "n", F.col(f"r{many}").alias("r0"))
        if not live.limit(1).count():
            break
    shares.unpersist()
    return reduce(DataFrame.unionByName, done)
