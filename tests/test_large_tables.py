"""Results and growth on rows that the smallest tables do not have."""

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as t
from corpusloom.functions.dialect import DUCK, SPARK
from corpusloom.operators import chunk, cluster, lexical, overlap
from corpusloom.plans import registry


@pytest.mark.parametrize("text", ["que erenstö ñrrado üben " * 3 + "uno dos tres " * 5, "one2 two_ thrée four five " * 9, "ñ ñ ñ " + "aña casa " * 18])
def test_languages_count_words_between_ascii_boundaries(spark, text):
    s = f"substring({t.text(SPARK)}, 1, 8000)"
    got = spark.createDataFrame([(text,)], "text string").selectExpr(f"{t.language(SPARK, 'text')} AS lang", f"size({SPARK.rx_all(s, SPARK.whole('[a-zA-Z]{3,}'))}) AS n").first()
    want = duckdb.execute(f"SELECT {t.language(DUCK, 'text')}, len(regexp_extract_all(text, '\\b[a-zA-Z]{{3,}}\\b')) FROM (SELECT ? AS text) x", [text]).fetchone()
    assert tuple(got) == want


def test_mixture_adds_up_blocks_of_components(spark):
    x = np.random.default_rng(3).normal(size=(150, 4)).round(3)
    df = spark.createDataFrame([(g, i, v.tolist()) for g in ("a", None) for i, v in enumerate(x)], "grp string, pos long, x array<double>")
    m = cluster.soft_gmm(x, 30)
    found = cluster.mixture(df, F.floor(F.col("n") / 5), rows_per_task=40, block=7)
    assert {(r.grp, r.pos, r.cluster) for r in found.collect()} == {(g, int(i), int(c)) for g in ("a", None) for i, c in zip(*np.nonzero(m))}


def test_shares_are_products_of_few_rows_at_a_time():
    r = np.random.default_rng(5)
    x, mean, var, mix = r.normal(size=(90, 3)), r.normal(size=(20, 3)), r.random((20, 3)) + 0.1, np.full(20, 0.05)
    logp = np.log(mix) - 0.5 * (np.log(var).sum(1) + (((x[:, None] - mean) ** 2) / var).sum(2))
    want = np.exp(logp - logp.max(1, keepdims=True))
    parts = list(cluster._responsibilities(x, mean, var, mix, 200))
    assert len(parts) == 9 and np.allclose(np.concatenate([p for _, p in parts]), want / want.sum(1, keepdims=True))


def test_common_ngrams_are_counted_without_a_shuffle(spark, sf):
    """Repeated documents count together, as in the oracle; the words of others stay in their task."""
    rows = [(1, "a b a b", "a b c a b a"), (2, "", "x"), (None, "q", "q q"), (1, "b a", "b b"), (None, "q", "")]
    df = spark.createDataFrame(rows, "doc_id int, pred string, ref string")
    got = {r.doc_id: tuple(r)[1:] for r in overlap.overlaps(df, (1, 2)).collect()}
    assert got == {1: (6.0, 6, 8, 3.0, 4, 6), 2: (0.0, 0, 1, 0.0, 0, 0), None: (2.0, 2, 2, 0.0, 0, 1)}
    plan = registry.queries()["bleu"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "hashpartitioning" not in plan


def test_ranks_among_all_of_the_few_that_leave_tasks(spark):
    rng = np.random.default_rng(8)
    docs = [(i, f"s{i % 3}" if i % 7 else None, [(w, 9.0, float(rng.integers(1, 3))) for w in ("a", "b", "c") if rng.random() < 0.6]) for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, source string, words array<struct<w: string, dl: double, tf: double>>").repartition(5)
    weights = {("q", "a"): 1.0, ("q", "b"): 0.5, ("r", "c"): 2.0, ("r", "x"): 1.0}
    how = (lexical.blocks(spark.createDataFrame([(*k, v) for k, v in weights.items()], "qid string, w string, weight double"), 1), "string", 9.0, 1.5, 0.75)
    found = lexical.best(df, *how, 4, 3, 2).where("way <> 'n'")
    got = {(r.qid, r.doc_id): (r.rb, r.rd) for r in lexical.places(df, *how, found).collect()}
    for q in ("q", "r"):
        score = {i: (round(sum(weights[q, w] * tf * 2.5 / (tf + 1.5) for w, _, tf in ws if (q, w) in weights), 9), sum((q, w) in weights for w, *_ in ws)) for i, _, ws in docs if any((q, w) in weights for w, *_ in ws)}
        rb, rd = (sorted(score, key=lambda i: (-score[i][k], i)) for k in (0, 1))
        assert {(q, i) for i in rb[:4] + rd[:3]} <= set(got)
        assert all(got[q, i] == (rb.index(i) + 1, rd.index(i) + 1) for p, i in got if p == q)
        for s in ("s0", "s1", "s2", None):
            assert {(q, i) for i in [i for i in rb if docs[i][1] == s][:2]} <= set(got)


def test_chunks_leave_before_their_batch_is_done(spark):
    batch = pa.RecordBatch.from_arrays([pa.array(range(200)), pa.array(["a b. c d."] * 199 + [None])], names=["id", "text"])
    seen = []
    first = next(chunk.chunked(iter([batch]), lambda x: seen.append(x) or [(0, x, 2), {"index": 1, "text": x, "tokens": 2}]))
    assert len(seen) == chunk.DOCUMENTS_HELD and first.num_rows == 2 * len(seen)


def test_screened_shares_are_all_that_count():
    """Blocks of alike rows leave out components of no share; sums and members are those of all components."""
    r = np.random.default_rng(6)
    centres = r.normal(size=(300, 6))
    mean = np.repeat(centres, 8, 0) + r.normal(size=(2400, 6)) * 0.05
    x = centres[r.integers(0, 300, 700)] + r.normal(size=(700, 6)) * 0.05
    var, mix = np.full((2400, 6), 0.004) * (1 + r.random((2400, 6))), r.dirichlet(np.ones(2400))
    whole = np.concatenate([q for _, q in cluster._responsibilities(x, mean, var, mix)])
    got, parts = np.zeros_like(whole), 0
    for at, both, near, q in cluster._shares(x, mean, var, mix):
        assert np.array_equal(both, np.concatenate([np.ones((len(at), 1)), x[at], x[at] ** 2], 1))
        got[np.ix_(at, np.arange(2400)[near])] = q
        parts += q.size
    assert parts < 0.7 * whole.size and np.abs(got - whole).max() < 1e-12 and (got.argmax(1) == whole.argmax(1)).all()


def test_single_precision_is_not_trusted_with_large_numbers():
    """Vectors so far out that sums in single precision cannot tell components apart are held against all."""
    r = np.random.default_rng(7)
    mean = 1e5 + r.normal(size=(cluster.SCREENED, 3))
    x, var, mix = mean[:50] + 0.01, np.full(mean.shape, 1e-3), np.full(len(mean), 1 / len(mean))
    assert all(q.shape[1] == len(mean) for *_, q in cluster._shares(x, mean, var, mix))


def test_large_groups_are_parted_by_their_products(spark, monkeypatch):
    """A group's vectors go to as many tasks as its part of all products asks for, not to one for every 65,536."""
    monkeypatch.setattr(cluster, "LEAST_ROWS", 1)
    x = np.random.default_rng(9).normal(size=(240, 3)).round(3)
    df = spark.createDataFrame([(g, i, v.tolist()) for g, n in (("large", 240), ("small", 20)) for i, v in enumerate(x[:n])], "grp string, pos long, x array<double>")
    names = []
    monkeypatch.setattr(cluster, "stored", lambda d, name, f=cluster.stored: names.append((name, f(d, name))) or names[-1][1])
    found = {(r.grp, r.pos, r.cluster) for r in cluster.mixture(df, F.floor(F.col("n") / 5)).collect()}
    want = {(g, int(i), int(c)) for g, n in (("large", 240), ("small", 20)) for i, c in zip(*np.nonzero(cluster.soft_gmm(x[:n], n // 5)))}
    each = {r.g: -(-r.n // r.each) for r in dict(names)["counts"].collect()}
    assert found == want and each["large"] >= 6 and each["small"] == 1
