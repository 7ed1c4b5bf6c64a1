import math
from collections import defaultdict

from corpusloom.llm.mixing import mix, targets


def fill(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Reshare by hand until no target is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, fixed = share * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        t = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if t[s] > most * sizes[s] + 1e-9]
        if not over:
            return fixed | t
        fixed |= {s: most * sizes[s] for s in over}


def test_targets_match_resharing(spark):
    sizes = {"a": 1, "b": 900, "c": 50, "d": 10, None: 40, "e": 0}
    got = targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"))
    want = fill(sizes)
    for r in got.collect():
        assert math.isclose(r.target, want[r.source], abs_tol=1e-6)


def test_mix_exact_budgets(spark):
    rows = [(i, " ".join(["w"] * (i % 17)), "hot" if i % 3 else f"s{i % 4}", 1) for i in range(600)]
    rows += [(7, None, "hot", 1), (7, None, "hot", 1), (None, "x y", None, 1), (900, "", "s0", 1), (901, " \t\x0b", "s1", 1), (902, "a b c", "s1", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = mix(df).collect()
    assert len(got) == len(rows)
    taken, target, size = defaultdict(int), {}, {}
    for r in got:
        taken[r.source] += r.taken
        target[r.source], size[r.source] = r.target, r.source_size
        assert 0 <= r.taken <= 2 * r.size
    assert next(r.size for r in got if r.doc_id == 902) == 2
    assert all(taken[s] == math.floor(target[s]) for s in target)
    assert math.isclose(sum(target.values()), 1.5 * sum(size.values()))
    again = mix(df.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_empty(spark):
    assert mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
