import numpy as np

from corpusloom.llm.topk import quantized, search_cell, top_k


def brute(ids, m, k, every):
    out = []
    for i, x in zip(ids, m):
        if i % every == 0:
            s = sorted((-int(x @ y), int(j)) for j, y in zip(ids, m) if j != i)[:k]
            out += [(int(i), r + 1, j, -v) for r, (v, j) in enumerate(s)]
    return sorted(out)


def test_cell_matches_brute_force_with_ties():
    rng = np.random.default_rng(1)
    ids = rng.permutation(700).astype(np.int64)
    m = rng.integers(-4, 5, (700, 6))
    m[100:300] = m[100]  # one common vector
    q = ids % 20 == 0
    a, b, s = search_cell(ids[q], m[q], ids, m, 5, 32)
    a = ids[q][a]
    got = {}
    for x, y, z in zip(a.tolist(), b.tolist(), s.tolist()):
        got.setdefault(x, []).append((-z, y))
    want = {}
    for x, _, y, z in brute(ids, m, 5, 20):
        want.setdefault(x, []).append((-z, y))
    assert got == {k: sorted(v) for k, v in want.items()}


def test_query_end_to_end_many_cells(spark):
    rng = np.random.default_rng(2)
    m = rng.normal(size=(300, 8)) / 3
    rows = [(int(i), [float(x) for x in v], 1) for i, v in enumerate(m)]
    rows += [(1000, None, 1), (1001, [1.0, None], 1), (1002, [float("nan")] * 8, 1), (1003, [float("inf")] * 8, 1), (None, [0.0] * 8, 1), rows[5]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id int")
    v = quantized(df, "vec_id", "embedding")
    got = top_k(v, v.where("id % 20 = 0"), 7, rows_per_cell=64, queries_per_cell=8, block=16)
    every = [(i, x) for i, x in enumerate(np.floor(64 * m).astype(int))]
    every.append(every[5])  # the repeated row is a candidate of its own
    want = []
    for i, x in every:
        if i % 20 == 0:
            best = sorted((-int(x @ y), j) for j, y in every if j != i)[:7]
            want += [(i, r + 1, j, -z) for r, (z, j) in enumerate(best)]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got.collect()) == sorted(want)


def test_large_components_are_not_clipped(spark):
    rows = [(0, [1e8, 1.0]), (1, [1e7, 2.0]), (2, [-1e7, 0.5]), (3, [3e6, -1e9])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    v = quantized(df, "vec_id", "embedding")
    got = {(r.query_id, r.vec_id): r.score for r in top_k(v, v.where("id = 0"), 5).collect()}
    ints = {i: [int(64 * y) for y in x] for i, x in rows}
    assert got == {(0, j): ints[0][0] * ints[j][0] + ints[0][1] * ints[j][1] for j in (1, 2, 3)}


def test_beyond_a_long_is_an_error(spark):
    import pytest

    for x in ([1e18, 0.0], [1e16, 1e16]):
        v = quantized(spark.createDataFrame([(0, x), (1, x)], "vec_id long, embedding array<double>"), "vec_id", "embedding")
        with pytest.raises(Exception, match="too large|[Oo]verflow"):
            top_k(v, v.where("id = 0"), 5).collect()


def test_repeated_queries_and_clashing_names(spark):
    """Two rows of one query id: their lists are merged; other columns named like those inside do not matter."""
    rows = [(0, [1.0], 9, 9), (0, [-1.0], 9, 9), (1, [1.0], 9, 9), (2, [2.0], 9, 9)]
    v = quantized(spark.createDataFrame(rows, "vec_id long, v array<double>, place int, id int"), "vec_id", "v")
    got = [(r.rank, r.vec_id, r.score) for r in top_k(v, v.where("id = 0"), 3).orderBy("rank").collect()]
    assert got == [(1, 2, 64 * 128), (2, 1, 64 * 64), (3, 1, -64 * 64)]


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    v = quantized(df, "vec_id", "embedding")
    assert top_k(v, v.where("id % 20 = 0"), 5).count() == 0


def test_a_query_is_no_candidate_of_its_own_row_alone(spark):
    from corpusloom.llm.topk import placed

    rows = [(20, [3.0, 0.0]), (20, [1.0, 0.0]), (21, [2.0, 0.0])]
    v = placed(quantized(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding"))
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score // 4096) for r in top_k(v, v.where("id % 20 = 0"), 2).collect())
    assert got == sorted([(20, 1, 21, 6), (20, 2, 20, 3), (20, 1, 20, 3), (20, 2, 21, 2)])
