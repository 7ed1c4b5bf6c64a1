"""Vector retrieval, stores and micro-batches against plain Python on small cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions.arrow import embed
from corpusloom.operators import cluster, retrieve
from corpusloom.sources import stores
from corpusloom.streaming.batches import split_batches


def test_fusion_depth_covers_every_pool():
    n = retrieve.fusion_depth()
    score = lambda rd, rb: retrieve.DENSE_W / (retrieve.RRF_K + rd) + retrieve.BM25_W / (retrieve.RRF_K + rb)
    assert score(n + 1, 1) < score(retrieve.POOL, 10**9) <= score(n, 1) + 1e-12


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(list("abcdefghij"), rng.integers(0, 9))) for _ in range(150)] + [None, "", "a b", "a b"]
    rows = [(i, "st"[i % 2], x) for i, x in enumerate(texts)]
    queries = [(1, "a b c"), (2, "d"), (3, ""), (4, None), (5, "j i h g")]
    return rows, queries


def nearest(rows, query):
    q = embed(query or "", 64).astype(float)
    return sorted(((-round(float(q @ embed(t or "", 64).astype(float)), 9) + 0.0, i) for i, _, t in rows))


def test_dense_top_by_brute_force(spark, corpus):
    rows, queries = corpus
    chunks, asked = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5), spark.createDataFrame(queries, "qid int, query string")
    for block in (4096, 2):
        got = retrieve.dense_top(chunks, asked, 7, 64, block).collect()
        for qid, query in queries:
            mine = sorted(((r.rd, r.doc_id, r.sim) for r in got if r.qid == qid))
            want = nearest(rows, query)[:7]
            assert [m[1] for m in mine] == [w[1] for w in want] and np.allclose([m[2] for m in mine], [-w[0] for w in want], atol=1e-8)
    assert retrieve.dense_top(chunks, asked.limit(0), 3).count() == 0 and retrieve.dense_top(chunks.limit(0), asked, 3).count() == 0


def test_hybrid_by_ranking_all_chunks(spark, corpus):
    rows, queries = corpus
    chunks, asked = spark.createDataFrame(rows, "doc_id long, source string, text string"), spark.createDataFrame(queries, "qid int, query string")
    lexical, want = [], []
    for qid, query in queries:
        words = set((query or "").split())
        ranked = sorted((-len(words & set((t or "").split())), i) for i, _, t in rows if words & set((t or "").split()))
        rb = {i: r for r, (_, i) in enumerate(ranked, 1)}
        lexical += [(qid, i, r) for i, r in rb.items()]
        dense = nearest(rows, query)
        fused = sorted((-round(100 * (0.7 / (60 + rd) + 0.3 / (60 + rb.get(i, len(rb) + 1))), 9), i, -s) for rd, (s, i) in enumerate(dense, 1))[:8]
        scored = [(round(-0.6 * c + 0.4 * s, 9), i) for c, i, s in fused]
        good = [x for x in scored if x[0] >= 0.9] or sorted((x for x in scored[:3] if x[0] >= 0.15), key=lambda x: (-x[0], x[1]))[:1]
        seen: dict = {}
        for _, i in sorted(good, key=lambda x: (-x[0], x[1])):
            seen.setdefault(rows[i][1], []).append(i)
        kept = {i for x in seen.values() for i in x[:2]}
        want += [(qid, n, i) for n, i in enumerate([i for _, i in sorted(good, key=lambda x: (-x[0], x[1])) if i in kept][:5], 1)]
    got = retrieve.hybrid(chunks, asked, spark.createDataFrame(lexical, "qid int, doc_id long, rb int"), threshold=0.9, dim=64)
    assert sorted((r.qid, r["rank"], r.doc_id) for r in got.collect()) == want


def test_embedding_benchmark(spark):
    pairs, cosine, asked, hit, rr, cover = retrieve.benchmark_text(["a b", "c d", "a x"], "a b", 64)
    assert (pairs, asked, hit, rr, cover) == (2, 1, 1.0, 1.0, 1.0)
    assert cosine == pytest.approx(float(embed("a b", 64) @ embed("c d", 64) + embed("c d", 64) @ embed("a x", 64)), abs=1e-6)
    assert retrieve.benchmark_text([], "a", 8) is None and retrieve.benchmark_text(["a"], "z", 8)[2:5] == (0, 0.0, 0.0)
    out = retrieve.embedding_benchmark(spark.createDataFrame([(1, "One two. Three four."), (2, None), (3, "")], "doc_id int, text string")).orderBy("dimension").collect()
    assert [r.model for r in out] == ["hash-32", "hash-64", "hash-256"] and all(r.documents >= 1 and r.mrr == 1 for r in out)


def test_pca_by_numpy(spark):
    x = np.random.default_rng(0).normal(size=(40, 3)) * [5, 2, 1]
    got = cluster.pca_2d(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id int, embedding array<double>").repartition(3)).orderBy("vec_id").collect()
    c = x - x.mean(0)
    axes = np.linalg.svd(c, full_matrices=False)[2][:2]
    axes *= np.sign(axes[np.arange(2), np.abs(axes).argmax(1)])[:, None]
    want = c @ axes.T
    assert np.allclose([(r.x, r.y) for r in got], want / np.abs(want).max())
    assert cluster.pca_2d(spark.createDataFrame([], "vec_id int, embedding array<double>")).count() == 0


def test_vectors_round_trip(spark, tmp_path):
    rows = [("d1", "c1", [1.0, 2.0], {"page": "1"}), ("d1", "c2", [3.0, 4.0], {"page": "2"}), ("d2", "c3", [5.0, 6.0], None)]
    stores.write_vectors(spark.createDataFrame(rows, "document_id string, chunk_id string, vector array<double>, metadata map<string,string>"), f"{tmp_path}/v")
    got = {(r.document_id, r.chunk_id): (r.vector, r.metadata) for r in stores.read_vectors(spark, f"{tmp_path}/v").collect()}
    assert got == {(d, c): (v, m) for d, c, v, m in rows}
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "d9.vectors.json").write_text('{"document_id": "d9",\n "chunk_ids": ["a", "b"], "embeddings": [[1], [2]], "metadatas": []}')
    assert [tuple(r) for r in stores.read_vectors(spark, f"{tmp_path}/one", lines=False).orderBy("chunk_id").collect()] == [("d9", "a", [1.0], None), ("d9", "b", [2.0], None)]


def test_benchmark_results(spark, tmp_path):
    import os

    (tmp_path / "a.json").write_text('{"aggregate": {"dataset_name": "x", "model_name": "m", "samples_evaluated": 3, "key_findings": ["k"]}}')
    (tmp_path / "b.json").write_text('{"dataset_name": "y",\n "samples_evaluated": 4}')
    (tmp_path / "c.json").write_text("no json")
    os.utime(tmp_path / "a.json", (2e9, 2e9))
    got = stores.read_benchmarks(spark, str(tmp_path)).collect()
    assert [(r.filename, r.dataset, r.samples, r.key_findings) for r in got] == [("a.json", "x", 3, ["k"]), ("b.json", "y", 4, None)]


def test_resume_skips_what_is_done(spark, tmp_path):
    ran = []

    def model(fail):
        def run(df):
            ran.append(sorted(r.sample_id for r in df.collect()))
            if fail:
                raise ValueError("broken")
            return df.withColumn("summary", F.lit("s"))

        return run

    cells = spark.createDataFrame([(1,), (2,)], "sample_id int")
    with pytest.raises(ValueError):
        stores.resume(cells, {"one": model(False), "two": model(True)}, str(tmp_path))
    more = spark.createDataFrame([(1,), (2,), (3,)], "sample_id int")
    got = stores.resume(more, {"one": model(False), "two": model(False)}, str(tmp_path))
    assert ran == [[1, 2], [1, 2], [3], [1, 2, 3]]
    assert sorted((r.model, r.sample_id) for r in got.collect()) == [(m, i) for m in ("one", "two") for i in (1, 2, 3)]


def test_cache_lives_for_its_time(spark, tmp_path):
    now, built = [1000.0], []

    def build():
        built.append(1)
        return spark.range(len(built))

    c = stores.TableCache(spark, str(tmp_path), 60, lambda: now[0])
    assert [c.get("k", build).count(), c.get("k", build).count()] == [1, 1]
    now[0] += 61
    assert c.get("k", build).count() == 2 and len(built) == 2
    c.drop("k")
    assert c.get("k", build).count() == 3


def test_split_in_batches(spark, tmp_path):
    spark.createDataFrame([(i, "a" if i % 3 else "", "b" if i % 4 else None) for i in range(24)], "i int, article string, abstract string").repartition(3).write.parquet(f"{tmp_path}/in")
    seen, told = [], []
    n = split_batches(spark, f"{tmp_path}/in", lambda df, k: seen.extend(r.i for r in df.collect()), f"{tmp_path}/w", progress=lambda *x: told.append(x))
    assert sorted(seen) == [i for i in range(24) if i % 3 and i % 4] and n == 3
    assert [k for k, _ in told] == ["start", *["running", "done"] * 3, "finished"]
    assert split_batches(spark, f"{tmp_path}/in", lambda df, k: None, f"{tmp_path}/w") == 0
