import itertools
import re

import numpy as np
from pyspark.sql import functions as F

from corpusloom.llm import filteraudit as fa


def fails(t, copy):
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    return {x for x, y in zip("ABCDE", (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search(r"[#$%&*|]", t)), copy)) if y}


def brute(rows, good, toxic):
    """rows: (id, source, text); every order by its definition."""
    docs = []
    for i, s, t in rows:
        t = t or ""
        docs.append((i, s or "", fails(t, i is not None and any(j is not None and j < i and (u or "") == t for j, _, u in rows))))
    out = {}
    for part in {p for _, p, _ in docs}:
        own = [(i, f) for i, p, f in docs if p == part]
        shap = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = list(own)
            for k, x in enumerate(order):
                gone = [d for d in left if x in d[1]]
                left = [d for d in left if x not in d[1]]
                shap[x] += len(gone)
                out[part, "".join(order), k + 1] = [len(left), len(gone), sum(x in f for _, f in own) - len(gone), sum(f == {x} for _, f in own), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
        for order in itertools.permutations("ABCDE"):
            for k, x in enumerate(order):
                out[part, "".join(order), k + 1].append(shap[x])
    return out


def test_swaps_visit_every_order():
    for n in range(1, 6):
        order, seen = list(range(n)), {tuple(range(n))}
        for i in fa.swaps(n):
            order[i], order[i + 1] = order[i + 1], order[i]
            seen.add(tuple(order))
        assert len(seen) == len(list(itertools.permutations(range(n)))) == sum(1 for _ in fa.swaps(n)) + 1


def test_shapley_is_efficient():
    cells = np.random.default_rng(1).integers(0, 50, (3, 32, 3))
    orders, made = fa.walk(cells, "ABCDE")
    assert len(set(orders)) == 120
    lost = cells[:, 1:, 0].sum(1)
    assert (made[:, 0, :, 6].sum(1) == 120 * lost).all()  # shares of the five filters add up to all that goes
    assert (made[:, :, -1, 0] == cells[:, :1, 0]).all()


def test_against_brute_force(spark):
    long_ = " ".join(f"w{i}" for i in range(250))
    texts = [None, "", "a b", "a b", "a b", long_, long_ + " $", long_.upper(), "x " * 300, "x " * 300 + "#", "ÄÖ éa" * 40, "A" + "é" * 49, "a\x0bb\x0cc\rd", long_]
    rows = [(i, ("hot" if i % 3 else None, "", "s")[i % 3], t) for i, t in enumerate(texts)]
    rows += [(2, "hot", "a b"), (None, "hot", "a b"), (None, None, long_), (40, "s", "y" * 100_000)]
    good, toxic = {1, 2, 5, 8}, {2, 6, 9, 40}
    labels = [(i, int(i in good), int(i in toxic), 9) for i in range(50)] + [(2, 0, None, 9), (None, 1, 1, 9)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumns({c: F.lit("x") for c in ("part", "mask", "digest", "t", "good")})
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int, part int")
    got = {(r.part, r.filter_order, r.step): [r[c] for c in fa.COUNTS] for r in fa.audit_documents(df, lab).collect()}
    assert got == brute(rows, good, toxic)


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, source string, text string")
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert fa.audit_documents(df, lab).count() == 0
    one = fa.audit_documents(spark.createDataFrame([(1, "s", "$")], "doc_id long, source string, text string"), lab)
    assert one.count() == 600 and one.where("step = 5").agg(F.sum("kept")).first()[0] == 0
