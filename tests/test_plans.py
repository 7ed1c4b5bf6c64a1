"""What plans may not hold: a broadcast of what is exploded from texts, or more reads of the texts than needed."""

import re

import pytest

from corpusloom.plans import registry

SF = "/root/testdata/sf0.01"
TEXTS = ("documents", "pages", "conversations")
QUERIES = registry.queries()


def nodes(plan):
    yield plan
    for i in range(plan.children().size()):
        yield from nodes(plan.children().apply(i))


def physical(df):
    """The plan before adaptive execution; its choices of broadcasts rest on estimates that do not know what explode makes."""
    return df._jdf.queryExecution().sparkPlan()


def exploded_broadcasts(df):
    found = []
    for n in nodes(physical(df)):
        if n.nodeName() != "BroadcastHashJoin" and n.nodeName() != "BroadcastNestedLoopJoin":
            continue
        built = n.left() if n.buildSide().toString() == "BuildLeft" else n.right()
        below = [(x.nodeName(), x.toString()) for x in nodes(built)]
        if any(k.startswith("Generate") for k, _ in below) and any(k.startswith("Scan") and re.search(rf"/({'|'.join(TEXTS)})\.parquet", s) for k, s in below):
            found.append(n.simpleStringWithNodeId())
    return found


SQL = sorted(n for n in registry.oracle_sql() if n not in ("daily_stream",))


def test_no_broadcast_of_exploded_text(spark):
    bad = {}
    for name in SQL:
        found = exploded_broadcasts(QUERIES[name](spark, SF))
        if found:
            bad[name] = found
    assert not bad


def test_the_check_sees_a_broadcast(spark):
    spark.read.parquet(f"{SF}/documents.parquet").createOrReplaceTempView("seen")
    df = spark.sql("SELECT /*+ BROADCAST(w) */ s.doc_id FROM seen s JOIN (SELECT doc_id, explode(split(text, ' ')) AS x FROM seen) w ON s.doc_id = w.doc_id")
    assert exploded_broadcasts(df)


@pytest.mark.parametrize("name", ["bm25", "rrf", "hybrid_retrieve", "adaptive_context", "document_summary", "agentic_retry"])
def test_retrieval_plans_read_no_texts(spark, name):
    """Postings, and the texts that queries retrieved, are stored once before."""
    plan = physical(QUERIES[name](spark, SF))
    assert not [n for n in nodes(plan) if n.nodeName().startswith("Scan") and "/documents.parquet" in n.toString()]
