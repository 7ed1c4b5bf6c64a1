"""No sentence, line or word is left out of long texts; forms for many sentences equal those for few."""

import random

import numpy as np

from corpusloom.functions import arrow
from corpusloom.operators import summarize


def some_sentences(n, seed=1, words=300):
    r = random.Random(seed)
    return [" ".join(r.choices([f"w{i}" for i in range(words)], k=12)) + "." for _ in range(n)]


def test_graphless_ranks_equal_the_graph(monkeypatch):
    m = summarize.matrix(some_sentences(300))
    w = m.dense() @ m.dense().T
    np.fill_diagonal(w, 0)
    assert np.allclose(summarize.textrank(m), summarize.rank_nodes(w))
    few = summarize.lexrank(m), summarize.lsa(m)
    monkeypatch.setattr(summarize, "BLOCK", 32)
    assert np.allclose(few[0], summarize.lexrank(m)) and np.allclose(few[1], summarize.lsa(m), atol=1e-3)


def test_every_sentence_is_scored(spark):
    s = some_sentences(2601)
    text = " ".join(s)
    got = summarize.score_table(spark.createDataFrame([(1, text)], "doc_id int, text string")).collect()
    assert sorted(r.i for r in got) == list(range(len(summarize.sentences(text))))


def test_rouge_lsum_takes_the_union():
    assert arrow.union_lcs([["a", "b"], ["c", "d"]], [["a", "b", "c", "d"]]) == 4
    assert arrow.union_lcs([["a", "x"], ["a", "c"]], [["a", "b", "c"]]) == 2
    assert arrow.union_lcs([], [["a"]]) == 0 and arrow.union_lcs([["b"]], [["a"]]) == 0
    assert arrow.lcs_positions("x a b".split(), "a b x".split()) == {0, 1}


def test_glued_words():
    assert len(arrow.GLUED) == 60
    assert arrow.part_glued("độchính câutrả cánbộhướng") == "độ chính câu trả cán bộ hướng"
