"""What is made in the task that reads a text, once for all that needs it."""

import random

from pyspark.sql import functions as F

from corpusloom.operators import chunk, retrieve, summarize, tables
from corpusloom.plans import procedural

WORDS = "river town hill dam fish council spring stone iron".split()


def text_of(rng, lines):
    line = lambda: rng.choice(["", "1. Top", "2.1 Below it", "- item", " ".join(rng.choices(WORDS, k=rng.randrange(1, 60))) + rng.choice(". !"), " ".join(f"{rng.choice(WORDS)} {i}." for i in range(400))])
    return "\n".join(line() for _ in range(lines))


def names(df):
    plan = df._jdf.queryExecution().sparkPlan().toString()
    return plan, plan.count("FileScan")


def test_chunks_of_lines_are_those_of_elements(spark, monkeypatch):
    rng = random.Random(7)
    monkeypatch.setattr(tables, "ELEMENTS_HELD", 3)
    rows = [(i, text_of(rng, rng.randrange(0, 40))) for i in range(12)] + [(90, None), (91, ""), (None, text_of(rng, 20))]
    for given in (rows, [*rows, (90, "one line more"), (None, None)]):
        docs = spark.createDataFrame(given, "doc_id long, text string").repartition(3)
        tables.register(spark)
        docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\\n")).alias("i", "line")).createOrReplaceTempView("own_lines")
        paths = spark.sql("SELECT doc_id, i, CAST(NULL AS INT) AS page, kind, path, text FROM section_paths(TABLE(own_lines) PARTITION BY doc_id ORDER BY i)")
        for turn in (None, 0.3):
            got, want = tables.line_chunks(docs, turn), tables.element_chunks(paths, turn=turn)
            assert got.columns == want.columns and [t for _, t in got.dtypes] == [t for _, t in want.dtypes]
            assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_chunks_of_lines_make_no_row_for_a_line(spark, sf):
    plan, _ = names(procedural.QUERIES["chunk_element_turns"](spark, sf))
    assert "UDTF" not in plan and "posexplode" not in plan


def test_sentences_are_estimated_once(monkeypatch):
    rng, seen, plain = random.Random(2), [], chunk.estimate
    text = " ".join(" ".join(rng.choices(WORDS, k=6)) + f" {i}." for i in range(600))
    monkeypatch.setattr(chunk, "estimate", lambda x: seen.append(x) or plain(x))
    made = chunk.token_chunks(text)
    assert len(made) > 5 and len(seen) == 600 + len(made)


def test_benchmark_of_all_dimensions():
    rng = random.Random(3)
    for n in (0, 1, 2, 9):
        texts, query = [" ".join(rng.choices(WORDS, k=30)) for _ in range(n)], "the river town"
        want = [x for x in (retrieve.benchmark_text(texts, query, d) for d in (32, 64, 256)) if x]
        assert retrieve.benchmark_dims(texts, query, (32, 64, 256)) == want and len(want) == (3 if n else 0)


def test_summaries_by_several_algorithms_read_texts_once(spark, sf):
    docs = procedural.docs(spark, sf)
    got = procedural.QUERIES["extractive_parallel"](spark, sf)
    assert names(got)[1] == 1
    want = [repr((*r, a)) for a in ("textrank", "lexrank") for r in summarize.summarize(docs, a).collect()]
    assert sorted(repr(tuple(r)) for r in got.collect()) == sorted(want)
