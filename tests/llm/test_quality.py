import random
from collections import Counter, defaultdict
from math import exp, log

from corpusloom.llm import quality as q
from corpusloom.llm.common import Scratch
from corpusloom.session import table

TRUSTED = ["the cat sat on the mat. The end", "a dog ate the cat's hat!\nthen ran", "été où ça va? the theme of them", "Tôi đã học tiếng Việt được hai năm rồi", "今天天气很好，我们去公园散步。今天很好", "", None]


def slow_model(texts):
    """Interpolated modified Kneser-Ney of order 5 by dictionaries: p(context, character)."""
    top = Counter()
    for t in texts:
        c = "\n" * 4 + t
        top.update(c[i : i + 5] for i in range(len(c) - 4))
    tab = {5: dict(top)}
    for k in (4, 3, 2, 1):
        tab[k] = dict(Counter(g[1:] for g in tab[k + 1]))
    disc = {k: q.discounts(dict(Counter(v for v in t.values() if v <= 4))) for k, t in tab.items()}
    by = {k: defaultdict(dict) for k in tab}
    for k, t in tab.items():
        for g, n in t.items():
            by[k][g[:-1]][g[-1]] = n
    symbols = len(tab[1]) + 1

    def p(ctx, w):
        k = len(ctx) + 1
        low = 1 / symbols if k == 1 else p(ctx[1:], w)
        seen = by[k].get(ctx)
        if not seen:
            return low
        tot = sum(seen.values())
        cut = lambda n: disc[k][min(n, 3) - 1]
        return max(0, seen.get(w, 0) - (cut(seen[w]) if w in seen else 0)) / tot + sum(map(cut, seen.values())) / tot * low

    return p


def slow_perplexity(p, t):
    c = "\n" * 4 + t
    return exp(-sum(log(p(c[i : i + 4], c[i + 4])) for i in range(len(t))) / len(t))


def test_perplexity_matches_slow_model_both_ways(spark, monkeypatch):
    """Latin, Vietnamese and Chinese text, unknown characters, and a text cut into blocks; by lookup and by sharded joins."""
    rng = random.Random(1)
    letters = "".join(t or "" for t in TRUSTED) + "qz漢ß"
    texts = [t for t in TRUSTED if t] + ["the hat on the cat", "###", "今天去学校", "tiếng Anh", "x", "".join(rng.choices(letters, k=400)), "the hat on the cat", "", None]
    p, scratch = slow_model([t or "" for t in TRUSTED]), Scratch(spark)
    trained = q.train(spark.createDataFrame([(t,) for t in TRUSTED], "t string").repartition(3), scratch)
    docs = spark.createDataFrame(list(enumerate(texts)), "ppl int, text string")
    for block, most_rows in ((q.BLOCK, 10**6), (7, 10**6), (q.BLOCK, 0)):
        monkeypatch.setattr(q, "BLOCK", block)
        got = {r.ppl: r.perplexity for r in q.with_perplexity(docs, trained, scratch, most_rows=most_rows).collect()}
        for i, t in enumerate(texts):
            want = slow_perplexity(p, t) if t else float("inf")
            assert got[i] == want or abs(got[i] - want) < 1e-3 * want, (t, got[i], want)


def test_model_grows_with_the_text(spark):
    rng, scratch = random.Random(2), Scratch(spark)
    text = "".join(rng.choices("abcdefghijklmnop ", k=20_000))
    size = [q.train(spark.createDataFrame([(text[:n],)], "t string"), scratch)[0].count() for n in (2_000, 20_000)]
    assert size[1] > 4 * size[0]


def test_very_long_text(spark):
    scratch = Scratch(spark)
    trained = q.train(spark.createDataFrame([("abc abd abe " * 50,)], "t string"), scratch)
    got = q.with_perplexity(spark.createDataFrame([("abc abd abe " * 200_000,)], "text string"), trained, scratch).first().perplexity
    assert 1 < got < 2


def test_accuracy_on_labels(spark):
    sf = "/root/testdata/sf0.1"
    labels = table(spark, sf, "labels")
    got, (ppl, cut, keep) = q.classify(table(spark, sf, "documents"), q.trusted_ids(labels.where("doc_id % 2 = 0")))
    r = got.join(labels, "doc_id").where("doc_id % 2 = 1").groupBy("quality", keep).count().toPandas()
    n = {(a, bool(b)): c for a, b, c in r.to_numpy()}
    assert n[(1, True)] / (n[(1, True)] + n.get((1, False), 0)) > 0.98
    assert n[(0, False)] / (n[(0, False)] + n.get((0, True), 0)) > 0.85


def test_edges(spark):
    rows = [(1, None, "en", 1), (2, "", None, 1), (3, "fine words here", "en", 1), (3, "fine words here", "en", 1), (None, "x", "xx", 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, keep int")
    none = spark.createDataFrame([], "trusted_id long")
    got, names = q.classify(d, none)
    assert got.columns == ["doc_id", "text", "lang", "keep", "perplexity", "threshold", "keep_"]
    assert sorted((r.doc_id or 0, r.keep_) for r in got.collect()) == [(0, True), (1, False), (2, False), (3, True), (3, True)]
    some = spark.createDataFrame([(3,)], "trusted_id long")
    assert q.classify(d, some)[0].count() == 5
    assert q.classify(d.limit(0), some)[0].count() == 0
