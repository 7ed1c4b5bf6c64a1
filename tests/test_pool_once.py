"""Hybrid retrieval by vectors: ranks by BM25 only of what the vectors found, one pool for all tries; vectors of many texts at once."""

import numpy as np

from corpusloom.functions.arrow import embed, embed_all
from corpusloom.functions.dialect import SPARK
from corpusloom.operators import retrieve
from corpusloom.plans import procedural, retrieval


def test_ranks_are_those_among_all_pairs(spark, sf):
    ranks = retrieval.ranks_of(spark, sf)
    rk = spark.sql(f"WITH {retrieval.base(SPARK, whole=True)} SELECT qid, doc_id, rb FROM rk")
    docs, queries = procedural.docs(spark, sf), procedural.asked(spark, sf)
    near = retrieve.dense_top(docs, queries, 25)
    want = {(r.qid, r.doc_id): r.rb for r in rk.collect()}
    got, last = ranks(near)
    wanted = {(r.qid, r.doc_id) for r in near.collect()} & set(want)
    assert {(r.qid, r.doc_id): r.rb for r in got.collect()} == {k: want[k] for k in wanted} and wanted
    assert {r.qid: r["last"] for r in last.collect()} == {q: max(n for (p, _), n in want.items() if p == q) for q, _ in want}
    rows = lambda lexical: sorted(map(repr, retrieve.hybrid(docs, queries, lexical).collect()))
    assert rows(ranks) == rows(rk)


def test_all_tries_take_from_one_pool(spark, sf, monkeypatch):
    runs = []
    dense = retrieve.dense_top
    monkeypatch.setattr(retrieve, "dense_top", lambda *a, **k: runs.append(1) or dense(*a, **k))
    out = procedural.agentic_retry(spark, sf).collect()
    assert len(runs) == 1 and {r.qid for r in out} == {r.qid for r in procedural.asked(spark, sf).collect()}


def test_vectors_of_many_texts_are_those_of_each():
    rng = np.random.default_rng(4)
    texts = ["", "  ", "a", "Å a b A", "x " * 9000 + "y", *[" ".join(f"w{i}" for i in rng.zipf(1.3, rng.integers(0, 60))) for _ in range(300)]]
    for dim in (32, 64, 256):
        assert np.array_equal(embed_all(texts, dim), np.stack([embed(t, dim) for t in texts]))
    assert embed_all([], 8).shape == (0, 8)
