"""Queries without an SQL form: Arrow UDFs, per-document algorithms, streams. Tests check them against plain Python."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusloom.functions import arrow
from corpusloom.functions import letters as rules
from corpusloom.functions.dialect import DUCK, SPARK
from corpusloom.functions.text import col, sentences_raw, tok_c
from corpusloom.operators import assets, chunk, cluster, letters, likeness, retrieve, summarize, tables
from corpusloom.plans import retrieval, scores
from corpusloom.plans.corpus import SENTENCES
from corpusloom.plans.query import Book
from corpusloom.session import spread, stored, table, work_dir
from corpusloom.streaming import state
from corpusloom.streaming.daily import daily, run_daily_stream, stream_of

BOOK = Book()


def docs(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def pairs(spark, sf_dir):
    return docs(spark, sf_dir).withColumn("abstract", F.get(col(sentences_raw, "text"), F.lit(0)))


def add(name, f, oracle=None):
    BOOK.frame(name, f, oracle)


add("nfc", lambda s, d: docs(s, d).select("doc_id", F.md5(arrow.nfc("text")).alias("value")), "SELECT doc_id, md5(nfc_normalize(coalesce(text, ''))) AS value FROM documents")
add("fix_glued_words", lambda s, d: docs(s, d).select("doc_id", F.md5(arrow.fix_glued_words("text")).alias("value")))
add("strip_html", lambda s, d: table(s, d, "pages").select("page_id", arrow.strip_html("html").alias("text")))
add("clean_generated", lambda s, d: docs(s, d).select("doc_id", arrow.clean_generated("text").alias("text")))
add("cache_key_blake", lambda s, d: docs(s, d).select("doc_id", arrow.cache_key_blake("text").alias("key")))
add("hash_embed", lambda s, d: docs(s, d).select("doc_id", arrow.hash_embed("text").alias("vector")))
add("synonym_augment", lambda s, d: docs(s, d).select("doc_id", arrow.synonym_augment("text", "doc_id", {"the": "that", "la": "una", "der": "ein"}).alias("text")))
add("rougeL", lambda s, d: pairs(s, d).select("doc_id", arrow.rouge_l("abstract", "text").alias("f1")))
add("rougeLsum", lambda s, d: pairs(s, d).select("doc_id", arrow.rouge_lsum("abstract", "text").alias("f1")))
for a in summarize.RUNNERS:
    add(a if a != "tfidf" else "tfidf_summary", lambda s, d, a=a: summarize.summarize(docs(s, d), a))
add("extractive_parallel", lambda s, d: summarize.summaries(docs(s, d), ("textrank", "lexrank")))
add("select_summary", lambda s, d: summarize.summarize(docs(s, d), "tfidf", 5))
add("extractive_score_table", lambda s, d: summarize.score_table(docs(s, d)))
add("pagerank", lambda s, d: summarize.score_table(docs(s, d), "textrank").select("doc_id", "i", "score"))


def pagerank_graph(spark, sf_dir):
    """Twenty rounds of ranks over the graphs of sentence similarities."""
    return likeness.ranks(docs(spark, sf_dir), LINKED).select("doc_id", "i", F.round("rank", 9).alias("score"))


#: Similarity from which two sentences are linked.
LINKED = 0.1
add(
    "pagerank_graph",
    pagerank_graph,
    f"""WITH RECURSIVE {scores.TFIDF(DUCK)}, {scores.COSINE}, h AS (SELECT doc_id, i AS src, j AS dst, round(sim, 6) AS weight FROM e WHERE sim >= {LINKED}), b AS (SELECT * FROM h UNION ALL SELECT doc_id, dst, src, weight FROM h),
p AS (SELECT doc_id, src, dst, weight / sum(weight) OVER (PARTITION BY doc_id, src) AS share FROM b), z AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id) AS n, doc_id IN (SELECT doc_id FROM p) AS linked FROM ({SENTENCES(DUCK)}) x),
k AS (SELECT doc_id, i, 1e0 / n AS r, 0 AS step FROM z WHERE linked UNION ALL SELECT z.doc_id, z.i, 0.15e0 / z.n + 0.85e0 * coalesce(m.got, 0), q.step + 1 FROM z JOIN (SELECT DISTINCT step FROM k) q ON q.step < 20
  LEFT JOIN (SELECT p.doc_id, p.dst, sum(p.share * k.r) AS got FROM k JOIN p ON p.doc_id = k.doc_id AND p.src = k.i GROUP BY p.doc_id, p.dst) m ON m.doc_id = z.doc_id AND m.dst = z.i WHERE z.linked)
SELECT doc_id, i, round(r, 9) AS score FROM k WHERE step = 20 UNION ALL SELECT doc_id, i, round(1e0 / n, 9) FROM z WHERE NOT linked""",
)
add("hybrid_condense", lambda s, d: summarize.hybrid_condense(docs(s, d)))
add("map_reduce_summary", lambda s, d: summarize.map_reduce_summary(docs(s, d)))
add("build_sections", lambda s, d: chunk.build_sections(docs(s, d)))
for name, how in {"chunk_semantic_token": "token", "chunk_paragraph_overlap": "paragraph", "reconstruct_paragraphs": "merge"}.items():
    add(name, lambda s, d, how=how: chunk.chunk(docs(s, d), how))
add("chunk_embedding", lambda s, d: chunk.chunk(docs(s, d), "token", target=200).select("doc_id", "index", "chunk_id", arrow.hash_embed("text", 64).alias("vector")))
for name, how in {"chunk_semantic_fixed": "fixed", "chunk_semantic_dynamic": "dynamic", "chunk_semantic_window": "window"}.items():
    add(name, lambda s, d, how=how: chunk.chunk(docs(s, d), "semantic", rule=how))
add(
    "admin_clean_lines",
    lambda s, d: letters.clean_letters(docs(s, d)).select("doc_id", "letter", F.md5("text").alias("text_md5")),
    f"""WITH l AS ({rules.lines_of(DUCK, f"(SELECT doc_id, text FROM documents WHERE {rules.is_letter(DUCK)})")}), k AS ({rules.body(DUCK, "SELECT * FROM l", rules.HEAD_LINES)}),
b AS (SELECT l.doc_id, regexp_replace(regexp_replace(string_agg(line, chr(10) ORDER BY l.i), '\\n\\s*\\n\\s*\\n', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS body FROM l LEFT JOIN k ON l.doc_id = k.doc_id AND l.i = k.i WHERE k.i IS NOT NULL OR trim(line) = '' GROUP BY l.doc_id)
SELECT d.doc_id, coalesce({rules.is_letter(DUCK)}, false) AS letter, md5(CASE WHEN {rules.is_letter(DUCK)} THEN coalesce(body, '') ELSE text END) AS text_md5 FROM documents d LEFT JOIN b ON b.doc_id = d.doc_id""",
)
add("admin_clean_elements", lambda s, d: letters.clean_letter_elements(chunk.build_sections(docs(s, d))).select("doc_id", "i", "kind", "text"))
add("clean_element", lambda s, d: chunk.clean_lines(docs(s, d)))


def by_lateral(spark, sf_dir):
    tables.register(spark)
    table(spark, sf_dir, "documents").createOrReplaceTempView("documents")
    return spark.sql("SELECT doc_id, s.* FROM documents, LATERAL sections(text) s")


def by_lines(name, columns):
    """The table function ``name`` over every document's lines in order."""

    def run(spark, sf_dir):
        tables.register(spark)
        table(spark, sf_dir, "documents").createOrReplaceTempView("documents")
        spark.sql("SELECT doc_id, posexplode(split(coalesce(text, ''), '\\n')) AS (i, line) FROM documents").createOrReplaceTempView("lines")
        return spark.sql(f"SELECT {columns} FROM {name}(TABLE(lines) PARTITION BY doc_id ORDER BY i)")

    return run


add("sections_lateral", by_lateral)
add("section_paths", by_lines("section_paths", "doc_id, i, kind, level, path, text"))
add("paragraphs_fold", by_lines("paragraphs", "doc_id, index, text"))
add("chunk_element_tokens", lambda s, d: tables.line_chunks(docs(s, d)))
add("chunk_element_turns", lambda s, d: tables.line_chunks(docs(s, d), turn=0.3))
add("document_assets", lambda s, d: assets.document_assets(docs(s, d)))
add("multi_doc_summary_tree", lambda s, d: assets.merged_summaries(docs(s, d), "source"))
add("gmm_diag_soft", lambda s, d: cluster.gmm_members(table(s, d, "embeddings")))
add("raptor_tree", lambda s, d: cluster.raptor_tree(docs(s, d).select("source", F.col("doc_id").alias("chunk_id"), "text", arrow.hash_embed("text", 32).alias("vector"))))
add("pca_2d", lambda s, d: cluster.pca_2d(table(s, d, "embeddings")))


def asked(spark, sf_dir):
    """The benchmark's items as queries, by their first twelve words as in ``retrieval.base``."""
    table(spark, sf_dir, "benchmark").createOrReplaceTempView("benchmark")
    items = retrieval.ITEMS.format(words=SPARK.slice(tok_c(SPARK), "1", "12"))
    return spark.sql(f"SELECT qid, array_join(qt, ' ') AS query FROM ({items}) q")


add("hybrid_retrieve_vectors", lambda s, d: retrieve.hybrid(docs(s, d), asked(s, d), retrieval.ranks_of(s, d)))
add("semantic_search_vectors", lambda s, d: retrieve.dense_top(docs(s, d), asked(s, d), 10).select("qid", "doc_id", F.col("sim").alias("score"), "rd"))


def agentic_retry(spark, sf_dir):
    """Hybrid retrieval, tried again for the queries whose context is too short; all tries take from one pool, as only threshold and number change."""
    queries, texts = stored(asked(spark, sf_dir), "asked"), docs(spark, sf_dir)
    pool = stored(retrieve.pooled(texts, queries, retrieval.ranks_of(spark, sf_dir)), "pool")
    held = stored(texts.join(F.broadcast(pool.select(F.col("doc_id").alias("d")).distinct()), F.col("doc_id") == F.col("d"), "left_semi"), "held")
    search = lambda left, top, threshold: retrieve.picked(pool.join(left.select(F.col("qid").alias("q")), F.col("qid") == F.col("q"), "left_semi"), held, top, threshold)
    return retrieve.with_retries(search, queries, held)


add("agentic_retry", agentic_retry)
add("embedding_benchmark", lambda s, d: retrieve.embedding_benchmark(docs(s, d)))
DAILY_SQL = "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2"
add("daily_windows", lambda s, d: daily(table(s, d, "events")).withColumn("total", F.round("total", 6)), DAILY_SQL)


def daily_stream(spark, sf_dir):
    work = f"{work_dir(spark).rstrip('/')}/daily-{uuid.uuid4().hex}"
    return run_daily_stream(spark, f"{sf_dir}/events.parquet", work).withColumn("total", F.round("total", 6))


add("daily_stream", daily_stream, DAILY_SQL)
#: Time to live of the query below: an hour.
HOUR = 3_600_000


def ttl_cache_stream(spark, sf_dir):
    """Events as requests for their user's entry, kept for an hour after its last use: which found it."""
    work = f"{work_dir(spark).rstrip('/')}/cache-{uuid.uuid4().hex}"
    events = stream_of(spark, f"{sf_dir}/events.parquet")
    requests = events.select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("request"), F.col("ts").cast("timestamp").alias("at"), F.col("event_type").alias("value"))
    state.answered(requests, HOUR, by_use=True).writeStream.format("parquet").option("path", f"{work}/out").option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(state.ANSWERS).parquet(f"{work}/out").where("found <> 'expired'").select("request", "key", "found")


add(
    "ttl_cache_stream",
    ttl_cache_stream,
    f"SELECT event_id AS request, CAST(user_id AS VARCHAR) AS key, CASE WHEN epoch_ms(ts) - lag(epoch_ms(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) < {HOUR} THEN 'hit' ELSE 'miss' END AS found FROM events",
)

QUERIES, ORACLE = BOOK.queries, BOOK.oracle
