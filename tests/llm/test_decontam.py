import random

import numpy as np

from corpusloom.llm import decontam as d
from corpusloom.session import table


def brute(items, text, overlap=0.8):
    """Items of which one passage (every start) holds enough shingles, by plain containment."""
    words = d.words_of(text.encode())
    out = []
    for i, q, a in items:
        w = d.words_of(f"{q} {a}".encode())
        own = d.shingles(w)
        if not own:
            continue
        held = d.shingles(words, min(len(w), 5)) if words else set()
        share = lambda x: 1.0 if not x else len(d.shingles(x) & d.shingles(words, min(len(x), 5))) / len(d.shingles(x))
        if len(own & held) / len(own) >= overlap and min(share(d.words_of(x.encode())) for x in (q or "", a or "")) >= 0.5:
            out.append(i)
    return sorted(out)


def make(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)] + ["the", "of", "and"] * 60
    items = [(i, " ".join(rng.choices(vocab, k=rng.randrange(3, 40))) + ".", " ".join(rng.choices(vocab, k=rng.randrange(0, 8)))) for i in range(40)]
    texts = []
    for _ in range(120):
        w = rng.choices(vocab, k=rng.randrange(0, 400))
        for _ in range(rng.randrange(0, 3)):
            _, q, a = rng.choice(items)
            x = f"{q} {a}".split()
            if rng.random() < 0.5:
                x = x[rng.randrange(0, 1 + len(x) // 4) :]
            at = rng.randrange(0, len(w) + 1)
            w[at:at] = x
        texts.append(" ".join(w))
    return items, texts


def test_matches_brute_force():
    for seed in range(3):
        items, texts = make(seed)
        index = d.build(items)
        for t in texts:
            assert sorted(x[0] for x in d.leaks(index, t.upper().encode())) == brute(items, t)


def test_search_retrieves_all_above_threshold():
    items, _ = make(5)
    index = d.build(items)
    rng = np.random.default_rng(2)
    weights = np.zeros((len(index.terms), len(index.items)))
    for t, (i, v) in enumerate(index.postings):
        weights[t, i] = v
    for _ in range(300):
        q = np.unique(rng.integers(0, len(index.terms), rng.integers(1, 60)))
        s = weights[q].sum(0)
        assert sorted(i for i, _ in d.search(index, q)) == np.flatnonzero(s >= 1).tolist()


def test_frames(spark):
    items = spark.createDataFrame([(1, "One two three four five six seven. Eight nine ten."), (2, None), (None, "x y"), (3, "just words here now ok"), (3, "just words here now ok")], "item_id long, text string")
    docs = spark.createDataFrame([(10, "zz one two three four five six seven eight nine ten zz", 1), (11, None, 1), (12, "", 1), (10, "just WORDS, here now ok", 1), (None, "just words here now ok", 1)], "doc_id long, text string, score int")
    got = d.contaminated(docs, d.split_items(items)).collect()
    assert sorted((r.doc_id or 0, r.item_id) for r in got) == [(0, 3), (10, 1), (10, 3)]
    assert all(r.overlap == r.question_overlap == r.answer_overlap == 1 for r in got)
    many = d.contaminated(docs, d.split_items(items), items_per_shard=1).collect()
    assert sorted((r.doc_id or 0, r.item_id) for r in many) == [(0, 3), (10, 1), (10, 3)]
    assert d.contaminated(docs, d.split_items(items.limit(0))).count() == 0
    assert d.contaminated(docs.limit(0), d.split_items(items)).count() == 0


def test_table_against_brute_force(spark, sf):
    items = d.split_items(table(spark, sf, "benchmark"))
    got = {(r.doc_id, r.item_id) for r in d.contaminated(table(spark, sf, "documents"), items).collect()}
    its = [tuple(r) for r in items.collect()]
    assert got == {(r.doc_id, i) for r in table(spark, sf, "documents").collect() for i in brute(its, r.text)}


def test_question_without_its_answer_is_no_leak(spark):
    question, answer = " ".join(f"q{i}" for i in range(60)), " ".join(f"a{i}" for i in range(8))
    items = spark.createDataFrame([("x-1", question, answer)], "item_id string, question string, answer string")
    docs = spark.createDataFrame([(1, f"zz {question} zz"), (2, f"zz {question} {answer} zz"), (3, f"{answer} zz")], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in d.contaminated(docs, items, "item_id").collect()] == [(2, "x-1")]


def test_very_long_text(spark):
    items = spark.createDataFrame([(1, "One two three four five six seven. Eight nine ten.")], "item_id long, text string")
    text = "filler words of prose " * 200_000 + "one two three four five six seven eight nine ten" + " more filler" * 100_000
    assert d.contaminated(spark.createDataFrame([(1, text), (2, text[:900_000])], "doc_id long, text string"), d.split_items(items)).count() == 1
