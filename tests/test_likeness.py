"""Sentence graphs made where texts are read: rows of repeated and null ids, plans without a shuffle of words or pairs."""

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from corpusloom.operators import likeness, summarize
from corpusloom.plans import registry

TEXTS = ["The quick fox runs home. A slow fox walks home.\n\nThe quick dog sleeps. 1 2 3.", "Un perro corre. El perro duerme. Der Hund.", "", None, "x", "Same words here. Same words here! Same words there? fox home"]
NAMES = ["sentence_cosine", "ranking_graph", "extractive_explanations", "pagerank_graph"]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Repeated and null ids, null and empty texts."""
    path = tmp_path_factory.mktemp("odd")
    rows = [(i, "s", x) for i, x in enumerate(TEXTS * 2)] + [(0, "s", TEXTS[5]), (0, "s", TEXTS[1]), (5, "s", TEXTS[5]), (None, "s", TEXTS[0]), (None, "s", TEXTS[5])]
    spark.createDataFrame(rows, "doc_id long, source string, text string").coalesce(1).write.parquet(f"{path}/documents.parquet")
    return str(path)


@pytest.mark.parametrize("name", NAMES)
def test_rows_of_odd_tables_are_those_of_the_sql(spark, odd, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{odd}/documents.parquet/*.parquet'")
    cur = con.execute(registry.oracle_sql()[name])
    names = [x[0] for x in cur.description]
    plain = lambda r: tuple(float(f"{x:.12g}") if isinstance(x, float) else x for x in r)
    want = sorted((plain(r) for r in cur.fetchall()), key=repr)
    got = sorted((plain(r[c] for c in names) for r in registry.queries()[name](spark, odd).collect()), key=repr)
    assert len(got) > 5 and got == want


@pytest.mark.parametrize("name", NAMES)
def test_no_word_and_no_pair_is_shuffled(spark, sf, name):
    plan = registry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "hashpartitioning" not in plan


def test_ranks_of_a_graph_in_blocks(monkeypatch):
    """A graph above four blocks is made anew each round; its ranks are those of the whole."""
    text = [" ".join((f"w{i % 17}", f"v{i % 5}", f"u{i % 29}")) for i in range(120)]
    m = likeness.weigh(pa.array([[text]]))
    places, rows = m.graph(0)
    whole = likeness.node_ranks(m, 0, m.all_i, 0.1)
    monkeypatch.setattr(likeness, "BLOCK", 16)
    monkeypatch.setattr(summarize, "BLOCK", 16)
    assert len(places) == 120 and np.allclose(likeness.node_ranks(m, 0, m.all_i, 0.1), whole, atol=1e-12)


def test_equal_sentences_are_taken_once(spark, tmp_path):
    """Many equal lines: the forty first pairs and all ranks are those of the SQL."""
    text = "\n".join(("fox home", f"dog {i % 3} runs", "fox home", f"cat v{i % 50}")[i % 4] for i in range(260))
    spark.createDataFrame([(1, "s", text), (2, "s", "fox\n" * 90 + "dog fox")], "doc_id long, source string, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in NAMES:
        cur = con.execute(registry.oracle_sql()[name])
        names = [x[0] for x in cur.description]
        assert sorted(tuple(r[c] for c in names) for r in registry.queries()[name](spark, str(tmp_path)).collect()) == sorted(cur.fetchall())


def test_classes_bound_what_is_multiplied(monkeypatch):
    m = likeness.weigh(pa.array([[["fox home", "dog"] * 3000]]))
    made = []
    monkeypatch.setattr(likeness, "graph_rows", lambda rows: made.append(rows.n) or summarize.graph_rows(rows))
    likeness.node_ranks(m, 0, m.all_i, 0.1)
    assert made == [2]
