"""Explanations of a summary: best match, rank of importance, keywords and reason of each of its sentences."""

import math
from collections import Counter

from pyspark.sql import functions as F

from corpusloom.operators import likeness

LINES = "fox home den\nThe red fox runs home. The red fox runs home.\nA slow dog sleeps; dog, dog.\nfox home\nOne cat. Two cats! Many cats and many dogs run home?\n12"
ROWS = [(1, LINES), (1, "Same words here. Same words there?"), (None, "x"), (2, ""), (3, None), (4, "7\n1 / 2"), (5, "và là của")]


def plainly(sentences, summary):
    """The reference's steps over sentences and their words."""
    words = [[w for w in "".join(c if c.isalnum() or c == "_" else " " for c in s.lower()).split() if len(w) > 1 and w not in likeness.EXPLAIN_STOPS] for s in (*sentences, *summary)]
    source, asked = words[: len(sentences)], words[len(sentences) :]
    df = Counter(w for x in source for w in set(x))
    score = [(round(sum(math.log((len(source) + 1) / (df[w] + 1)) + 1 for w in set(x)) + min(len(set(x)), 30) / 30, 9), i) for i, x in enumerate(source)]
    ranked = {i: r + 1 for r, (_, i) in enumerate(sorted(score, reverse=True))}
    for s, own in zip(summary, asked):
        best = (0, 0.0)
        for i, x in enumerate(source):
            alike = len(set(own) & set(x)) / len(set(own) | set(x)) if own and x else 0.0
            if alike > best[1]:
                best = (i, alike)
        yield s, best[0] + 1, ranked[best[0]], round(best[1], 4), ", ".join(w for w, _ in Counter(source[best[0]]).most_common(5))


def test_steps_of_an_explanation(spark):
    got = [r for r in likeness.explanations(spark.createDataFrame(ROWS, "doc_id int, text string")).collect()]
    first = [r for r in got if r.doc_id == 1 and "Same" not in r.sentence]
    sentences = ["fox home den", "The red fox runs home.", "The red fox runs home.", "A slow dog sleeps; dog, dog.", "fox home", "One cat.", "Two cats!", "Many cats and many dogs run home?", "12"]
    want = list(plainly(sentences, [r.summary_sentence for r in first]))
    assert [(r.summary_sentence, r.i, r.importance_rank, r.similarity, r.keywords) for r in first] == want
    assert [r.nth for r in first] == list(range(1, len(first) + 1)) and len({r.i for r in first}) > 1
    for r in first:
        assert r.sentence == sentences[r.i - 1] and r.reason == likeness.REASONS[r.importance_rank > 3].format(*([r.similarity] if r.importance_rank > 3 else []), r.keywords)
    assert [(r.sentence, r.i, r.similarity) for r in got if r.doc_id is None] == [("x", 1, 0.0)]
    assert [r.reason for r in got if r.doc_id == 5] == [likeness.REASONS[0].format(likeness.REASONS[2])]
    assert not [r for r in got if r.doc_id in (2, 3, 4)]


def test_sentences_without_an_end_are_matched_together(spark):
    """The first two make one sentence of the summary, which is nearer to the third line than to either."""
    text = "red fox 1\nruns home.\nred fox runs\n2\nảnh: x"
    found = likeness.explanations(spark.createDataFrame([(1, text)], "doc_id int, text string")).orderBy("nth").collect()
    assert [(r.nth, r.summary_sentence, r.i, r.similarity) for r in found] == [(1, "red fox 1 runs home.", 3, 0.75), (2, "red fox runs", 3, 1.0)]


def test_equal_ranks_go_to_the_later_sentence(spark):
    found = likeness.explanations(spark.createDataFrame([(1, "aa bb.\ncc dd.")], "doc_id int, text string")).orderBy("nth").collect()
    assert [r.importance_rank for r in found] == [2, 1]


def test_every_row_is_a_text_of_its_own(spark):
    docs = spark.createDataFrame([(1, "red fox."), (1, "dog.")], "doc_id int, text string")
    assert sorted(r.importance_rank for r in likeness.explanations(docs).select(F.col("importance_rank")).collect()) == [1, 1]
