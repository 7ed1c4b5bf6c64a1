"""Algorithms spread over tasks give what their per-group forms give."""

import random

import numpy as np
from pyspark.sql import functions as F

from corpusloom.functions import arrow
from corpusloom.operators import cluster, graph, order, summarize
from corpusloom.session import table


def test_numbered_and_percentiles(spark):
    r = random.Random(2)
    rows = [(i, r.choice(["hot"] * 6 + ["a", None]), r.randrange(40)) for i in range(900)] + [(900, "lone", 5), (901, "a", None)]
    df = spark.createDataFrame(rows, "id int, g string, v int").repartition(5)
    got = {x.id: (x["rank"], x.rank_of) for x in order.numbered(df.where("v is not null"), [F.desc("v"), F.col("id")], ["g"]).collect()}
    groups = {}
    for i, g, v in rows:
        if v is not None:
            groups.setdefault(g, []).append((-v, i))
    want = {i: (n, len(x)) for x in groups.values() for n, (_, i) in enumerate(sorted(x), 1)}
    assert got == want
    whole = {x.id: x["rank"] for x in order.numbered(df, [F.col("id")]).collect()}
    assert whole == {i: n for n, (i, *_) in enumerate(rows, 1)}
    for linear in ((), ("p5", "p90")):
        out = {x.g: (x.p5, x.p90) for x in order.percentiles(df, "v", {"p5": 0.5, "p90": 0.9}, ["g"], linear, "id").collect()}
        for g, x in groups.items():
            x = sorted(-v for v, _ in x)
            at = [p * (len(x) - 1) for p in (0.5, 0.9)]
            assert np.allclose(out[g], [np.interp(a, range(len(x)), x) for a in at] if linear else [x[int(a)] for a in at])
    assert order.numbered(df.limit(0), [F.col("id")], ["g"]).count() == 0


def test_no_task_orders_all_rows(spark):
    df = spark.range(5000).withColumn("g", F.lit("one"))
    plan = order.numbered(df, [F.col("id")], ["g"])._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Window" not in plan


def small_graphs():
    r = np.random.default_rng(4)
    for g in range(8):
        n = int(r.integers(1, 9))
        w = r.random((n, n)) * (r.random((n, n)) < 0.4)
        np.fill_diagonal(w, 0)
        if g == 3:
            w[:] = 0
        yield g, w


def test_pagerank_equals_the_dense_form(spark):
    nodes, edges = [], []
    for g, w in small_graphs():
        nodes += [(g, i) for i in range(len(w))]
        edges += [(g, int(j), int(i), float(w[i, j])) for i, j in zip(*np.nonzero(w))]
    edges += [(0, 77, 0, 1.0), (99, 0, 1, 1.0), (1, 0, 0, 0.0)]  # unknown node and graph, no weight
    got = graph.pagerank(spark.createDataFrame(nodes, "graph int, node int"), spark.createDataFrame(edges, "graph int, src int, dst int, weight double")).collect()
    by = {(x.graph, x.node): x["rank"] for x in got}
    assert len(by) == len(got) == len(nodes)
    for g, w in small_graphs():
        assert np.allclose([by[g, i] for i in range(len(w))], summarize.rank_nodes(w), atol=1e-6)
    lost = sum(v for (g, _), v in by.items() if g == 1)
    assert lost <= 1 + 1e-9


def test_pagerank_of_one_large_graph(spark):
    n, m = 100_000, 1_000_000
    edges = spark.range(m).select(F.lit(0).alias("graph"), (F.xxhash64("id") % n + n).cast("long").alias("src"), (F.xxhash64(F.col("id") + 7) % n + n).cast("long").alias("dst"), F.lit(1.0).alias("weight"))
    nodes = edges.select("graph", F.col("src").alias("node")).union(edges.select("graph", "dst")).distinct()
    out = graph.pagerank(nodes, edges, rounds=5, cut_every=5)
    total, many = out.agg(F.sum("rank"), F.count("*")).first()
    assert many == nodes.count() and 0.9 < total <= 1 + 1e-9


def test_mixture_equals_the_group_form(spark, sf):
    given = table(spark, sf, "embeddings").select("vec_id", "label", "embedding")
    v = given.union(spark.createDataFrame([(10**6, 99, [1.0] * 64), (10**6 + 1, None, [2.0] * 64), (10**6 + 2, 99, None)], given.schema))
    groups = {}
    for r in sorted(v.where("embedding is not null").collect(), key=lambda r: r.vec_id):
        groups.setdefault(r.label, []).append((r.vec_id, np.array(r.embedding, float)))
    want = set()
    for g, x in groups.items():
        m = cluster.soft_gmm(np.stack([y for _, y in x]), 3)
        want |= {(g, x[i][0], int(c)) for i, c in zip(*np.nonzero(m))}
    got = {(r.label, r.vec_id, r.cluster) for r in cluster.gmm_members(v).collect()}
    assert got == want


def test_one_group_over_many_tasks(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 1, (60, 3)) for c in (0, 6, -5)])
    df = spark.createDataFrame([(None, i, v.tolist()) for i, v in enumerate(x)], "grp string, pos long, x array<double>")
    m = cluster.soft_gmm(x, 3)
    got = {(r.pos, r.cluster) for r in cluster.mixture(df, F.lit(3), rows_per_task=16).collect()}
    assert got == {(int(i), int(c)) for i, c in zip(*np.nonzero(m))}


def tree_of_one(ids, texts, x, levels=3):
    """One source's tree, level by level in memory."""
    out = []
    for level in range(1, levels + 1):
        if len(ids) < 3:
            break
        m = cluster.soft_gmm(x, max(2, len(ids) // 5))
        fresh = []
        for c in range(m.shape[1]):
            at = np.flatnonzero(m[:, c])
            if len(at):
                text = ". ".join(s.strip() for s in " ".join(texts[i] for i in at).split(".")[:3])
                out.append((level, f"{level}-{c}", tuple(ids[i] for i in at), text))
                fresh.append((f"{level}-{c}", text, x[at].mean(0)))
        ids, texts, x = [f[0] for f in fresh], [f[1] for f in fresh], np.stack([f[2] for f in fresh])
    return out


def test_tree_equals_the_form_in_memory(spark, sf):
    docs = table(spark, sf, "documents").where("source in ('src1', 'src2')").select("source", F.col("doc_id").alias("chunk_id"), "text", arrow.hash_embed("text", 16).alias("vector"))
    docs = docs.union(spark.createDataFrame([("tiny", 1, "a. b", [1.0] * 16), ("tiny", 2, "c", [1.0] * 16)], docs.schema))
    groups = {}
    for r in sorted(docs.collect(), key=lambda r: r.chunk_id):
        groups.setdefault(r.source, []).append(r)
    want = {(s, *x) for s, rows in groups.items() for x in tree_of_one([str(r.chunk_id) for r in rows], [r.text or "" for r in rows], np.stack([np.array(r.vector, float) for r in rows]))}
    got = {(r.source, r.level, r.node, tuple(r.children), r.text) for r in cluster.raptor_tree(docs).collect()}
    assert got == want and not any(s == "tiny" for s, *_ in got)


def test_neighbours_and_running_sums(spark):
    r = random.Random(6)
    rows = [(i, r.choice(["a", "a", "b", None]), r.randrange(-5, 9)) for i in range(300)]
    ranked = order.numbered(spark.createDataFrame(rows, "id int, g string, v int"), [F.col("id")], ["g"])
    both = order.running_sum(order.with_previous(ranked, ["g"], {"v": "was"}), F.col("v"), ["g"], "sum", block=16)
    got = {x.id: (x.was, x["sum"]) for x in both.collect()}
    last, total = {}, {}
    for i, g, v in rows:
        total[g] = total.get(g, 0) + v
        assert got[i] == (last.get(g), total[g])
        last[g] = v
