"""Table functions give the rows of the per-document functions; retries see only what is left."""

from pyspark.sql import functions as F

from corpusloom.functions import text as t
from corpusloom.functions.dialect import SPARK
from corpusloom.operators import chunk, retrieve, tables
from corpusloom.plans import corpus, retrieval
from corpusloom.session import table

TEXT = "1 Intro\ntext goes on here without end\nand ends here.\n\n1.1 Part\n- item\n2 Next\nmore words"


def docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text").union(spark.createDataFrame([(10**6, TEXT), (10**6 + 1, None), (10**6 + 2, "")], "doc_id long, text string"))


def test_table_functions(spark, sf):
    tables.register(spark)
    given = docs(spark, sf)
    given.createOrReplaceTempView("given")
    spark.sql("SELECT doc_id, posexplode(split(coalesce(text, ''), '\\n')) AS (i, line) FROM given").createOrReplaceTempView("given_lines")
    rows = lambda df: sorted(map(str, df.collect()))
    want = rows(chunk.build_sections(given))
    assert want and rows(spark.sql("SELECT doc_id, s.* FROM given, LATERAL sections(text) s")) == want
    assert rows(spark.sql("SELECT * FROM section_paths(TABLE(given_lines) PARTITION BY doc_id ORDER BY i)")) == want
    merged = rows(chunk.chunk(given, "merge").select("doc_id", "index", "text"))
    assert rows(spark.sql("SELECT * FROM paragraphs(TABLE(given_lines) PARTITION BY doc_id ORDER BY i)")) == merged
    for how in ("token", "paragraph"):
        assert rows(spark.sql(f"SELECT doc_id, c.index, c.text, c.tokens FROM given, LATERAL chunks(text, '{how}') c")) == rows(chunk.chunk(given, how).select("doc_id", "index", "text", "tokens"))


def test_word_chunks_against_a_loop(spark):
    texts = ["a b. c d e. " * 400, "", None, "  ", "one " * 600 + ". two.", "x. " * 9000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").createOrReplaceTempView("documents")
    got = {(r.doc_id, r["index"]): r.text for r in spark.sql(corpus.word_chunks(SPARK)).collect()}
    split = {r.doc_id: r.a for r in spark.sql(f"SELECT doc_id, {t.sentences_raw(SPARK)} AS a FROM documents").collect()}
    want = {}
    for i, text in enumerate(texts):
        out, size = [], 0
        for s in split[i]:
            n = len(s.split())
            if not out or size + n > 491:
                out.append([])
                size = 0
            out[-1].append(s)
            size += n
        want |= {(i, k): " ".join(c) for k, c in enumerate(out[:16])} if out else {(i, 0): text or ""}
    assert got == want


def test_variants_of_queries(spark):
    cases = {"RAG là gì vậy bạn?": ["rag được định nghĩa như thế nào vậy bạn?", "RAG là gì vậy bạn"], "Kể tên các thành phố lớn nhất": ["thành phố lớn nhất"], "Tại sao trời xanh": ["nguyên nhân trời xanh"], "hai từ": [], "": [], "What is this thing??": ["What is this thing"]}
    df = spark.createDataFrame([(k,) for k in cases], "text string")
    got = {r.text: r.v for r in df.select("text", F.expr(retrieval.variants(SPARK)).alias("v")).collect()}
    assert got == cases


def test_retries_in_three_rounds(spark):
    """Scores by (query, chunk): query 0 is content at once, 1 after one retry, 2 after two, 3 never, 4 finds nothing."""
    scores = {(0, 0): 0.9, (0, 1): 0.3, (1, 2): 0.26, (1, 3): 0.18, (2, 4): 0.12, (3, 5): 0.5, (4, 6): 0.05}
    length = {0: 100, 1: 5, 2: 60, 3: 60, 4: 90, 5: 10, 6: 500}
    texts = spark.createDataFrame([(d, "x" * n) for d, n in length.items()], "doc_id int, text string")
    pairs = spark.createDataFrame([(q, d, s) for (q, d), s in scores.items()], "sq int, doc_id int, rerank double")
    asked = []

    def search(left, top, threshold):
        asked.append((sorted(r.qid for r in left.collect()), top, round(threshold, 2)))
        by = pairs.join(left, F.col("sq") == F.col("qid")).where(F.col("rerank") >= threshold)
        ranked = by.selectExpr("qid", "doc_id", "rerank", "row_number() OVER (PARTITION BY qid ORDER BY rerank DESC, doc_id) AS rank")
        return ranked.where(F.col("rank") <= top)

    queries = spark.createDataFrame([(i, f"q{i}") for i in range(5)], "qid int, query string")
    got = {}
    for r in retrieve.with_retries(search, queries, texts, top=1, threshold=0.25).collect():
        got.setdefault((r.qid, r.tries), []).append(r.doc_id)
    assert asked == [([0, 1, 2, 3, 4], 1, 0.25), ([1, 2, 3, 4], 3, 0.17), ([2, 3, 4], 5, 0.1)]
    assert {k: sorted(v, key=str) for k, v in got.items()} == {(0, 0): [0], (1, 1): [2, 3], (2, 2): [4], (3, 2): [5], (4, 2): [None]}
