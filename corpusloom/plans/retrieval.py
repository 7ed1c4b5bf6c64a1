"""Retrieval dataflow: BM25, fusion, reranking, context assembly (survey section 2.13)."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions import text as t
from corpusloom.functions.dialect import DUCK, SPARK
from corpusloom.operators import candidates, lexical
from corpusloom.operators.retrieve import fusion_depth
from corpusloom.plans.corpus import SENTENCES
from corpusloom.plans.query import Book
from corpusloom.session import spread, stored, table

BOOK = Book()
Q = BOOK.sql
#: BM25 and fusion constants, thresholds and sizes.
K1, B, RRF_K, DENSE_W, BM25_W = 1.5, 0.75, 60, 0.7, 0.3


def postings(d):
    """(doc_id, source, dl, w, tf): the words that queries hold, and for each document one row with the empty word; documents are tokenised here and nowhere else."""
    asked = f"SELECT {d.explode(d.slice(t.tok_c(d), '1', '12'))} AS w FROM benchmark"
    words = f"SELECT doc_id, source, {d.double(d.size('a'))} AS dl, {d.explode(d.union_all(d.array(d.lit('')), 'a'))} AS w FROM (SELECT doc_id, source, {t.tok_c(d)} AS a FROM documents) x"
    return f"SELECT doc_id, source, dl, w, {d.double('count(*)')} AS tf FROM ({words}) y WHERE w = '' OR w IN ({asked}) GROUP BY doc_id, source, dl, w"


#: The queries: each item of the benchmark by its first twelve words.
ITEMS = "SELECT item_id AS qid, {words} AS qt FROM benchmark"


def words_asked(d, asked):
    """CTEs of the queries' words and of the postings' statistics."""
    return f"""q AS ({asked.format(words=d.slice(t.tok_c(d), '1', '12'))}),
qw AS (SELECT qid, w, qtf, count(*) OVER (PARTITION BY qid) AS n FROM (SELECT qid, w, count(*) AS qtf FROM (SELECT qid, {d.explode('qt')} AS w FROM q) x GROUP BY qid, w) y),
st AS (SELECT {d.double('count(*)')} AS n, avg(dl) AS avgdl FROM postings WHERE w = ''), df AS (SELECT w, {d.double('count(*)')} AS df FROM postings WHERE w <> '' GROUP BY w)"""


def base(d, asked=ITEMS, whole=False):
    """A query for each benchmark item (its first twelve words) over the chunk set of all documents.

    Statistics are those of the candidate set; query words count as often as they occur; scores are
    divided by the query's largest. Postings are joined by term: no query meets a chunk it shares
    no term with; in Spark they are a stored table (see ``ranked``), so that no plan reads the texts twice.
    The dense side is a hash-free stand-in: the share of the query's words held.
    Unless a query needs the ``whole`` of rk, Spark takes only its rows that can be among the best, with their ranks
    among all (see ``store_ranks``).
    """
    fused = f"""rrf AS (SELECT *, 100 * ({DENSE_W}e0 / ({RRF_K} + rd) + {BM25_W}e0 / ({RRF_K} + rb)) AS combined FROM rk),
pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(combined, 9) DESC, doc_id) AS pos FROM rrf) x WHERE pos <= 8),
rr AS (SELECT *, 0.6e0 * combined + 0.4e0 * dense AS rerank FROM pool),
kept AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(rerank, 9) DESC, doc_id) AS rank FROM rr WHERE rerank >= 0.7e0 * 0.25e0)"""
    if d.name == "spark" and not whole:
        return f"rk AS (SELECT * FROM ranks), {fused}"
    held = "" if d.name == "spark" else f"postings AS ({postings(d)}),"
    return f"""{held}
{words_asked(d, asked)},
raw AS (SELECT /*+ MERGE(tf, qw, df) */ qw.qid, tf.doc_id, tf.source, round(sum(qw.qtf * ln((st.n - df.df + 0.5e0) / (df.df + 0.5e0) + 1) * tf.tf * {K1 + 1}e0 / (tf.tf + {K1}e0 * (1 - {B}e0 + {B}e0 * tf.dl / st.avgdl))), 9) AS s, {d.double('count(*)')} / max(qw.n) AS cov
  FROM qw JOIN df ON df.w = qw.w JOIN postings tf ON qw.w = tf.w CROSS JOIN st GROUP BY qw.qid, tf.doc_id, tf.source),
bm AS (SELECT qid, doc_id, source, s / max(s) OVER (PARTITION BY qid) AS bm25, round(cov, 9) AS dense FROM raw),
rk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY bm25 DESC, doc_id) AS rb, row_number() OVER (PARTITION BY qid ORDER BY dense DESC, doc_id) AS rd FROM bm),
{fused}"""


def store_postings(spark, sf_dir) -> None:
    """The view ``postings``: the table written once for the query that is asked."""
    for name in ("documents", "benchmark"):
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    stored(spark.sql(postings(SPARK)), "postings").createOrReplaceTempView("postings")


#: How many of each query's best by BM25 the queries below look at; by words held as many as can reach the pool.
DEEP = 30


def scoring(spark, asked=ITEMS) -> tuple:
    """What ``operators.lexical`` scores with, of the view ``postings``: documents with their words, blocks of queries, the type of their ids and BM25's constants."""
    docs = spread(stored(spark.sql("SELECT doc_id, source, collect_list(struct(w, dl, tf)) AS words FROM postings WHERE w <> '' GROUP BY doc_id, source"), "packed"))
    weights = stored(spark.sql(f"WITH {words_asked(SPARK, asked)} SELECT qid, qw.w, qtf * ln((st.n - df.df + 0.5e0) / (df.df + 0.5e0) + 1) AS weight FROM qw JOIN df ON df.w = qw.w CROSS JOIN st"), "weights")
    avgdl = spark.sql(f"WITH {words_asked(SPARK, asked)} SELECT avgdl FROM st").first().avgdl
    return docs, lexical.blocks(weights), dict(weights.dtypes)["qid"], avgdl, K1, B


def ranks_of(spark, sf_dir):
    """A function of (qid, doc_id): their ranks by BM25 among all documents that hold a word of the query (qid, doc_id, rb), and how many those are (qid, last); no row is made for other pairs."""
    store_postings(spark, sf_dir)
    how = scoring(spark)

    def ranks(near: DataFrame) -> tuple[DataFrame, DataFrame]:
        found = stored(lexical.held_by(*how, near), "held")
        last = found.where("doc_id IS NULL").groupBy("qid").agg(F.sum("matched").cast("int").alias("last")).where("last > 0")
        return lexical.places(*how, found.where("doc_id IS NOT NULL")).select("qid", "doc_id", "rb"), last

    return ranks


def store_ranks(spark, sf_dir, asked=ITEMS) -> None:
    """The view ``ranks``: of each query the rows of rk with rd or rb so low that one of the queries below can return them; rb and rd are those among all."""
    store_postings(spark, sf_dir)
    docs, *how = scoring(spark, asked)
    found = stored(lexical.best(docs, *how, DEEP, fusion_depth()), "best")
    sizes = spark.sql(f"WITH {words_asked(SPARK, asked)} SELECT qid AS of, max(n) AS n FROM qw GROUP BY qid")
    tops = found.where("way = 'n'").groupBy(F.col("qid").alias("tq")).agg(F.max("top").alias("top"))
    order = {"b": [F.desc("s"), F.col("doc_id")], "d": [F.desc("held"), F.col("doc_id")]}
    most = {"b": DEEP, "d": fusion_depth()}
    few = [found.where(F.col("way") == k).withColumn("nth", F.row_number().over(Window.partitionBy("qid").orderBy(*order[k]))).where(F.col("nth") <= most[k]) for k in order]
    rows = stored(reduce(DataFrame.unionByName, few).select("qid", "doc_id", "source", "s", "held").distinct(), "few")
    ranks = lexical.places(docs, *how, rows).select(*[F.col(c).alias(f"_{c}") for c in ("qid", "doc_id", "s", "held")], "rb", "rd")
    same = (F.col("qid") == F.col("_qid")) & F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("s") == F.col("_s")) & (F.col("held") == F.col("_held"))
    placed = rows.join(ranks, same).join(tops, F.col("qid") == F.col("tq")).join(sizes, F.col("qid") == F.col("of"))
    out = placed.select("qid", "doc_id", "source", (F.col("s") / F.col("top")).alias("bm25"), F.round(F.col("held") / F.col("n"), 9).alias("dense"), "rb", "rd")
    stored(out, "ranks").createOrReplaceTempView("ranks")


CONTEXT = "SELECT /*+ MERGE(x) */ k.qid, k.doc_id, k.rank, k.rerank, x.text FROM kept k JOIN documents x ON x.doc_id = k.doc_id"


def parted(d):
    """The sentences of what each query retrieved."""
    return f"SELECT qid, doc_id, rank, i + 1 AS i, s FROM (SELECT qid, doc_id, rank, {d.numbered('a', 'i', 's')} FROM (SELECT qid, doc_id, rank, {t.sentences_raw(d)} AS a FROM context) x) y"


def assembled(name, build):
    """Register a query over ``context``, the texts that each query retrieved: in Spark stored, in the oracle a subquery before the others."""

    def run(spark, sf_dir):
        store_ranks(spark, sf_dir)
        stored(spark.sql(f"WITH {base(SPARK)} {CONTEXT}"), "context").createOrReplaceTempView("context")
        return spark.sql(f"WITH {build(SPARK)}")

    BOOK.frame(name, run, f"WITH {base(DUCK)}, context AS ({CONTEXT}), {build(DUCK)}")


def ranked(name, build, asked=ITEMS, whole=False):
    """Register a query over ``base``: in Spark its ranks are stored first, or the postings where it needs the ``whole``."""

    def run(spark, sf_dir):
        if whole:
            store_postings(spark, sf_dir)
        else:
            store_ranks(spark, sf_dir, asked)
        return spark.sql(build(SPARK))

    BOOK.frame(name, run, build(DUCK))


ranked("bm25", lambda d: f"WITH {base(d)} SELECT qid, doc_id, round(bm25, 8) AS score, rb AS rank FROM rk WHERE rb <= 20")
ranked("join_rank_fusion", lambda d: f"WITH {base(d)} SELECT qid, doc_id, rd, rb FROM rk WHERE rb <= 30 OR rd <= 30")
ranked("rrf", lambda d: f"WITH {base(d)} SELECT qid, doc_id, round(combined, 6) AS combined, pos FROM pool")
ranked("rerank_fallback", lambda d: f"WITH {base(d)} SELECT qid, doc_id, round(rerank, 6) AS rerank, rank FROM kept")
ranked("retrieval_confidence", lambda d: f"WITH {base(d)} SELECT qid, round(least(0.99e0, max(rerank)), 6) AS confidence FROM kept GROUP BY qid")
ranked("dynamic_chunks", lambda d: f"WITH {base(d, whole=True)} SELECT qid, doc_id, round(bm25, 6) AS score FROM (SELECT qid, doc_id, bm25, rb, max(bm25) OVER (PARTITION BY qid) AS top FROM rk) x WHERE round(bm25, 8) >= greatest(0.85e0, 0.9e0 * top) OR rb = 1", whole=True)
assembled("context_compression", lambda d: f"z AS (SELECT qid, rank, {d.long('length(' + t.text(d) + ')')} AS n_chars FROM context) SELECT qid, count(*) AS chunks, {d.long('sum(n_chars)')} AS chars, {d.long('sum(CASE WHEN rank <= 3 THEN n_chars ELSE 0 END)')} AS kept_chars, CASE WHEN sum(n_chars) < 1500 THEN 'none' WHEN sum(n_chars) < 3000 THEN 'light' WHEN sum(n_chars) < 6000 THEN 'medium' ELSE 'aggressive' END AS tier FROM z GROUP BY qid")
assembled("document_summary", lambda d: f"p AS (SELECT qid, s, row_number() OVER (PARTITION BY qid ORDER BY rank, i) AS nth FROM ({parted(d)}) z WHERE length(s) > 15) SELECT qid, md5({d.join(d.collect('s', 'nth'), ' ')}) AS summary, count(*) AS sentences FROM p WHERE nth <= 8 GROUP BY qid")
Q("compression_tier", "documents", lambda d: "SELECT doc_id, CASE WHEN n_chars < 1500 THEN 'none' WHEN n_chars < 3000 THEN 'light' WHEN n_chars < 6000 THEN 'medium' ELSE 'aggressive' END AS tier FROM documents")
Q("extractive_answer", "documents", lambda d: f"SELECT doc_id, md5({d.join(d.collect('s', 'i'), ' ')}) AS answer, count(*) AS n FROM (SELECT doc_id, i, s, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS nth FROM ({SENTENCES(d)}) x WHERE length(s) > 15) y WHERE nth <= 8 GROUP BY doc_id")
Q("best_sentence_answer", "documents benchmark", lambda d: f"""
WITH q AS (SELECT {d.distinct(t.tok_c(d))} AS q FROM benchmark WHERE item_id = 1), s AS ({SENTENCES(d)}), h AS (SELECT doc_id, i, s, {d.double(d.size(d.intersect(d.distinct(t.tok_c(d, 's')), 'q')))} / {d.size('q')} AS share FROM s CROSS JOIN q)
SELECT doc_id, i, share, CASE WHEN share = 0 THEN 'not found' ELSE s END AS answer FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY share DESC, i) AS nth FROM h) x WHERE nth = 1""")
ranked("lexical_topk", lambda d: f"WITH {base(d)} SELECT qid, doc_id, dense AS score FROM rk WHERE rd <= 5")
ranked("semantic_search", lambda d: f"WITH {base(d)} SELECT qid, doc_id, source, dense AS score FROM rrf WHERE rd <= 10")
Q("attach_citations", "documents", lambda d: f"WITH s AS ({SENTENCES(d)}) SELECT doc_id, concat('[', i, '] ', substring(s, 1, 40)) AS citation FROM s WHERE i <= 3")
ranked("merge_fact_chunks", lambda d: f"WITH {base(d)} SELECT DISTINCT doc_id FROM kept UNION SELECT doc_id FROM documents x WHERE {d.rx_like(t.text(d), '[0-9]{5,}')}")
Q("query_focus", "conversations", lambda d: f"SELECT conv_id, turn, CASE WHEN {d.rx_like(f'lower({t.text(d)})', 'how many|combien|cuántos|wie viele|[0-9]')} THEN 'number' WHEN {d.rx_like(f'lower({t.text(d)})', 'who|qui|quién|wer')} THEN 'person' ELSE 'general' END AS focus, {d.join(d.slice(d.filter(t.tok_c(d), 'length(y) > 3', 'y'), '1', '5'), ' ')} AS terms FROM conversations WHERE role = 'user'")
#: Rewrites of questions, the first that fits counts; fewest words of a query that is expanded, and of one whose last words stand for it.
REWRITES = (
    ("là gì", "được định nghĩa như thế nào"),
    ("bao nhiêu", "số liệu"),
    ("tại sao", "nguyên nhân"),
    ("khi nào", "thời gian"),
    ("ai là", "vai trò"),
    ("khác nhau", "so sánh điểm khác biệt"),
    ("giống nhau", "điểm tương đồng"),
    ("ưu điểm", "lợi ích"),
    ("nhược điểm", "hạn chế"),
    ("mục tiêu", "mục đích"),
)
EXPANDED_WORDS, CORE_WORDS, CORE, MOST_VARIANTS = 3, 6, 4, 2


def variants(d, x="text"):
    """Up to two other wordings of the query ``x``: a rewrite, the question without its mark, and if there is neither the last words of a long one."""
    q = d.rx_rep(t.text(d, x), "^\\s+|\\s+$", "")
    low, words = f"lower({q})", d.rx_all(q, t.WORD_U)
    cut = lambda a, b: f"concat(substring({low}, 1, {d.pos(d.lit(a), low)} - 1), {d.lit(b)}, substring({low}, {d.pos(d.lit(a), low)} + {len(a)}))"
    rewrite = "CASE " + " ".join(f"WHEN {d.pos(d.lit(a), low)} > 0 THEN {cut(a, b)}" for a, b in REWRITES) + " END"
    plain = f"CASE WHEN {d.rx_like(q, '[?]$')} THEN {d.rx_rep(q, '[?]+$', '')} END"
    core = f"CASE WHEN {d.size(words)} >= {CORE_WORDS} AND {rewrite} IS NULL AND {plain} IS NULL THEN {d.join(d.slice(words, f'greatest(1, {d.size(words)} - {CORE - 1})', str(CORE)), ' ')} END"
    tidy = lambda v: d.rx_rep(v, "^\\s+|\\s+$", "")
    found = d.filter(d.array(tidy(rewrite), tidy(plain), core), f"v IS NOT NULL AND v <> '' AND lower(v) <> {low}", "v")
    return f"CASE WHEN {d.size(words)} < {EXPANDED_WORDS} THEN {d.empty()} ELSE {d.slice(found, '1', str(MOST_VARIANTS))} END"


Q("expand_query", "conversations", lambda d: f"SELECT conv_id, turn, {d.join('v', ' | ')} AS variants, {d.size('v')} AS n FROM (SELECT conv_id, turn, {variants(d)} AS v FROM conversations WHERE role = 'user') x")
#: Each query in two wordings, the item's words and its last four of them.
WORDINGS = lambda d: f"SELECT item_id * 2 AS qid, w AS qt FROM (SELECT item_id, {{words}} AS w FROM benchmark) w1 UNION ALL SELECT item_id * 2 + 1, {d.slice('w', f'greatest(1, {d.size("w")} - 3)', '4')} FROM (SELECT item_id, {{words}} AS w FROM benchmark) w2"
ranked("merge_candidates", lambda d: f"WITH {base(d, WORDINGS(d))}, v AS (SELECT {d.long('floor(qid / 2)')} AS item_id, qid % 2 AS wording, doc_id, rb FROM rk WHERE rb <= 30) SELECT item_id, doc_id, {d.long('wording')} AS wording, {d.long('rb')} AS r FROM (SELECT *, row_number() OVER (PARTITION BY item_id, doc_id ORDER BY wording, rb) AS nth FROM v) x WHERE nth = 1", WORDINGS(SPARK))
ranked("dense_rank_positions", lambda d: f"WITH {base(d)} SELECT qid, doc_id, {d.long('rd')} AS pos FROM rk WHERE rd <= 50")
#: The sources that a user chose, how many chunks of each the context must hold, and the size of the pool.
CHOSEN, LEAST_EACH = "('src0', 'src1', 'src2')", 2
ranked("coverage_backfill", lambda d: f"""
WITH {base(d, whole=True)}, p AS (SELECT qid, doc_id, source, row_number() OVER (PARTITION BY qid ORDER BY round(combined, 9) DESC, doc_id) AS pos FROM rrf),
f AS (SELECT *, row_number() OVER (PARTITION BY qid, source ORDER BY pos) AS nth FROM p) SELECT qid, doc_id, source, CASE WHEN pos <= 8 THEN 'top' ELSE 'fill' END AS how FROM f WHERE pos <= 8 OR source IN {CHOSEN} AND nth <= {LEAST_EACH}""", whole=True)
#: Fixed value: the share of a query's words from which a chunk counts as relevant.
RELEVANT = 0.55
ranked("retrieval_metrics", lambda d: f"""
WITH {base(d, whole=True)}, r AS (SELECT qid, rb AS rank, CASE WHEN dense >= {RELEVANT}e0 THEN 1 ELSE 0 END AS rel FROM rk), n AS (SELECT qid, rank, rel, sum(rel) OVER (PARTITION BY qid) AS total FROM r)
SELECT qid, {d.double('sum(rel)')} / 10 AS precision_10, {d.double('sum(rel)')} / greatest(1, max(total)) AS recall_10, max(CASE WHEN rel = 1 THEN 1e0 / rank ELSE 0e0 END) AS mrr, max(rel) AS hit, round(sum(rel / log2(rank + 1e0)), 9) AS dcg FROM n WHERE rank <= 10 GROUP BY qid""", whole=True)
Q("multi_doc_summary", "documents", lambda d: f"SELECT source, md5({d.join(d.collect('lead', 'doc_id'), ' ')}) AS summary, count(*) AS n FROM (SELECT doc_id, source, {d.get(t.sentences_raw(d), 1)} AS lead FROM documents) x WHERE lead IS NOT NULL GROUP BY source")
Q("assets", "documents", lambda d: f"SELECT doc_id, concat('Q: ', {t.first_words(d, 'text', 6)}, '?') AS flashcard, {d.join(d.slice(d.filter(t.tok_d(d), 'length(y) > 5', 'y'), '1', '5'), ', ')} AS slide FROM documents")

#: The tokens a summary may take in each tier.
TIER_TOKENS = {"light": 200, "medium": 280, "aggressive": 350}
FACT = "[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]+(?:[.,][0-9]+)? ?%|[0-9]{5,}"


def adaptive(d):
    """Context assembly for each query: tier by the size of what was retrieved, the chunks of high score or with facts, a summary of leading sentences within the tier's tokens, its citations (each sentence cites the chunk it stands in), sizes before and after."""
    limit = " ".join(f"WHEN tier = '{k}' THEN {v}" for k, v in TIER_TOKENS.items())
    tokens = lambda n: f"greatest(1, {d.long(f'floor({n} / 3.5e0)')})"
    return f"""
fx AS (SELECT DISTINCT qid, doc_id, {d.explode(d.rx_all(t.text(d), FACT))} AS fact FROM context),
k AS (SELECT k.qid, k.doc_id, k.rank, {d.long(f"length({t.text(d, 'k.text')})")} AS chars, CASE WHEN k.rank = 1 OR rerank >= greatest(0.85e0, 0.9e0 * max(rerank) OVER (PARTITION BY k.qid)) OR f.doc_id IS NOT NULL THEN 1 ELSE 0 END AS keep, rerank
  FROM context k LEFT JOIN (SELECT DISTINCT qid, doc_id FROM fx) f ON f.qid = k.qid AND f.doc_id = k.doc_id),
m AS (SELECT qid, count(*) AS chunks_total, {d.long('sum(keep)')} AS chunks_kept, {d.long('sum(chars)')} AS input_chars, {d.long('sum(keep * chars)')} AS kept_chars, round(0.9e0 * max(rerank), 6) AS dynamic_threshold FROM k GROUP BY qid),
tr AS (SELECT *, CASE WHEN input_chars < 1500 THEN 'none' WHEN input_chars < 3000 THEN 'light' WHEN input_chars < 6000 THEN 'medium' ELSE 'aggressive' END AS tier FROM m),
p AS (SELECT /*+ MERGE(s) */ s.qid, s.s, tr.tier, sum({tokens('length(s.s)')}) OVER (PARTITION BY s.qid ORDER BY s.rank, s.i) AS used FROM ({parted(d)}) s JOIN tr ON tr.qid = s.qid WHERE length(s.s) > 15 AND tr.tier <> 'none'),
y AS (SELECT qid, {d.long('sum(length(s)) + count(*) - 1')} AS summary_chars, count(*) AS citations FROM p WHERE used <= CASE {limit} ELSE 0 END GROUP BY qid),
nf AS (SELECT qid, count(DISTINCT fact) AS facts FROM fx GROUP BY qid),
z AS (SELECT tr.qid, CASE WHEN y.qid IS NULL THEN 'none' ELSE tier END AS tier, chunks_total, chunks_kept, input_chars, kept_chars + coalesce(summary_chars, 0) AS output_chars, {tokens('input_chars')} AS input_tokens, {tokens('kept_chars')} + {tokens('coalesce(summary_chars, 0)')} AS output_tokens, coalesce(citations, 0) AS citations, coalesce(facts, 0) AS facts, dynamic_threshold FROM tr LEFT JOIN y ON y.qid = tr.qid LEFT JOIN nf ON nf.qid = tr.qid)
SELECT *, round({d.double('output_chars')} / greatest(1, input_chars), 4) AS compression_ratio, round(1 - {d.double('output_tokens')} / greatest(1, input_tokens), 4) AS token_reduction FROM z"""


assembled("adaptive_context", adaptive)

# ordered packing that a window can state
#: Sums of a source are joined to its documents; what rounding leaves goes to its last document.
Q("allocate_budgets", "documents", lambda d: f"""
WITH w AS (SELECT source, doc_id, {d.long(t.n_words(d))} AS n FROM documents), s AS (SELECT source AS of_, sum(n) AS total, max(doc_id) AS last FROM w GROUP BY source),
b AS (SELECT source, doc_id, last, greatest(20, {d.long('floor(2000e0 * n / greatest(1, total))')}) AS budget FROM w JOIN s ON source IS NOT DISTINCT FROM of_),
g AS (SELECT source AS of_, sum(budget) AS spent FROM b GROUP BY source)
SELECT source, doc_id, {d.long('CASE WHEN doc_id = last THEN greatest(20, 2000 - (spent - budget)) ELSE budget END')} AS budget FROM b JOIN g ON source IS NOT DISTINCT FROM of_""")

#: How a node of a RAPTOR tree begins where it is kept as a chunk, and what a question that asks for a summary holds.
SUMMARY_CHUNK, SUMMARIZE = "[Tóm tắt phân cấp", ("tóm tắt", "summarize", "tóm lược", "khái quát", "bản tóm tắt")
#: Chunks that a query takes of all sources, the least of each, and those that another wording of it adds of each, or of the only one.
INITIAL, LEAST_FIRST, MORE_EACH, MORE_ALONE = 30, 5, 3, 5


def wordings(d):
    """(qid, wording, intent, a): each query's words, wording 0, and unless it asks for a summary those of its expansions."""
    intent = f"CASE WHEN {' OR '.join(f'{d.pos(d.lit(w), "lower(query)")} > 0' for w in SUMMARIZE)} THEN 'SUMMARIZE' ELSE 'DOCUMENT_QA' END"
    queries = f"SELECT qid, query, {intent} AS intent FROM (SELECT qid, {d.join('qt', ' ')} AS query FROM ({ITEMS.format(words=d.slice(t.tok_c(d), '1', '12'))}) z) y"
    more = f"SELECT qid, intent, {d.numbered('vs', 'i', 'v')} FROM (SELECT qid, intent, {variants(d, 'query')} AS vs FROM ({queries}) x WHERE intent <> 'SUMMARIZE') w"
    return f"SELECT qid, 0 AS wording, intent, {t.tok_c(d, 'query')} AS a FROM ({queries}) q0 UNION ALL SELECT qid, i + 1, intent, {t.tok_c(d, 'v')} FROM ({more}) q1"


def vectors_of(name, key, rows):
    """The oracle's CTE ``name`` (``key``, vec): vectors of ``rows`` (``key``, a) as ``operators.candidates`` has them."""
    cells = f"SELECT {key}, md5_number_lower(w) % {candidates.DIM} AS c, sum(CASE WHEN md5_number_lower(w) >= 9223372036854775808 THEN 1 ELSE -1 END) AS v FROM (SELECT {key}, unnest(a) AS w FROM {rows}) e GROUP BY ALL"
    return f"{name} AS (SELECT {key}, list(coalesce(v, 0)::DOUBLE ORDER BY c) AS vec FROM (SELECT {key}, c FROM {rows} CROSS JOIN (SELECT range AS c FROM range({candidates.DIM})) r) g LEFT JOIN ({cells}) h USING ({key}, c) GROUP BY {key})"


#: The oracle's chunks: of rows that repeat an id the first by source and text; and the cosine of two vectors.
CHUNKS = f"chunks AS (SELECT doc_id, source, starts_with(coalesce(text, ''), '{SUMMARY_CHUNK}') AS summary, {t.tok_c(DUCK)} AS a FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY source NULLS LAST, text NULLS LAST) AS nth FROM documents WHERE doc_id IS NOT NULL) x WHERE nth = 1)"
COSINE = "CASE WHEN list_inner_product(w.vec, v.vec) = 0 THEN 0e0 ELSE list_inner_product(w.vec, v.vec) / sqrt(list_inner_product(w.vec, w.vec) * list_inner_product(v.vec, v.vec)) END"
SOURCES = "sz AS (SELECT count(*) AS sources FROM (SELECT DISTINCT source FROM chunks) x)"


def gathered(d):
    """Of ``near`` (qid, wording, intent, doc_id, source, summary, sim) and ``sz`` each wording's nearest chunks of each source, a chunk once, by the first wording that found it; only summaries where one is asked for and found."""
    most = f"CASE WHEN wording = 0 AND sources > 1 THEN greatest({LEAST_FIRST}, {d.long(f'floor({INITIAL}e0 / sources)')}) WHEN wording = 0 THEN {INITIAL} WHEN sources > 1 THEN {MORE_EACH} ELSE {MORE_ALONE} END"
    return f"""top AS (SELECT near.*, {most} AS most, row_number() OVER (PARTITION BY qid, wording, source ORDER BY sim DESC, doc_id) AS k FROM near CROSS JOIN sz),
once AS (SELECT *, row_number() OVER (PARTITION BY qid, doc_id ORDER BY wording, k) AS nth, max(CASE WHEN summary THEN 1 ELSE 0 END) OVER (PARTITION BY qid) AS found FROM top WHERE k <= most)
SELECT qid, doc_id, source, {d.long('wording')} AS wording, {d.long('k')} AS k, round(sim, 9) AS score FROM once WHERE nth = 1 AND (intent <> 'SUMMARIZE' OR found = 0 OR summary)"""


def chunks_of(spark, sf_dir, asked):
    """The documents as ``operators.candidates`` has chunks, and the view ``sz`` of how many sources they have."""
    table(spark, sf_dir, "benchmark").createOrReplaceTempView("benchmark")
    rows = candidates.unique(spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text")))
    words = SPARK.join(t.tok_c(SPARK), " ")
    out = candidates.packed(rows.select("doc_id", "source", F.coalesce(F.col("text").startswith(SUMMARY_CHUNK), F.lit(False)).alias("summary"), F.expr(words).alias("words")), asked)
    spark.createDataFrame([(out.select("source").distinct().count(),)], "sources long").createOrReplaceTempView("sz")
    return out


def gather_candidates(spark, sf_dir):
    table(spark, sf_dir, "benchmark").createOrReplaceTempView("benchmark")
    asked = spark.sql(wordings(SPARK))
    rows = asked.orderBy("qid", "wording").collect()  # up to three a query
    chunks = chunks_of(spark, sf_dir, [])
    blocks = candidates.asked_blocks([((r.qid, r.wording), r.a) for r in rows], sorted({w for r in rows for w in r.a}))
    sources = spark.table("sz").first().sources
    near = stored(candidates.nearest(chunks, blocks, dict(asked.dtypes)["qid"], max(LEAST_FIRST, INITIAL // max(1, sources))), "near")
    intents = spark.createDataFrame([(r.qid, r.intent) for r in rows if not r.wording], f"q {dict(asked.dtypes)['qid']}, intent string")
    near.join(intents, F.col("qid") == F.col("q")).drop("q").createOrReplaceTempView("near")
    return spark.sql(f"WITH {gathered(SPARK)}")


BOOK.frame("gather_candidates", gather_candidates, f"""
WITH {CHUNKS}, {SOURCES}, wq AS ({wordings(DUCK)}), {vectors_of('cv', 'doc_id', 'chunks')}, wi AS (SELECT qid * 10 + wording AS wid, a FROM wq), {vectors_of('wv', 'wid', 'wi')},
near AS (SELECT wq.qid, wq.wording, wq.intent, c.doc_id, c.source, c.summary, {COSINE} AS sim FROM wq JOIN wv w ON w.wid = wq.qid * 10 + wq.wording CROSS JOIN chunks c JOIN cv v ON v.doc_id = c.doc_id),
{gathered(DUCK)}""")

#: The pool that is reranked and the least results, thresholds for one and for several sources and where nothing reaches them, the share of them that holds without a model, results that each of several sources has at least.
POOL, FINAL, ALONE, SEVERAL, RELAXED, EASED, LEAST_OF = 8, 10, 0.35, 0.25, 0.15, 0.7, 2


def retrieved(d):
    """Of ``rk`` (qid, doc_id, source, sim, held, n, rd, rb) and ``sz`` what a query retrieves: ranks fused, the pool reranked and held to a threshold, or relaxed to its best, then spread over sources and filled
    up from the whole fusion so that each source has its least; ``FINAL`` results, or as many as the sources need for that.

    Fused scores are not rounded before they are ordered, so a chunk that is behind another by both ranks is behind it.
    """
    floor = lambda a: d.long(f"floor({a})")
    return f"""lim AS (SELECT sources, greatest({FINAL}, {LEAST_OF} * sources) AS top_k, CASE WHEN sources > 1 THEN {SEVERAL}e0 ELSE {ALONE}e0 END AS least, CASE WHEN sources > 2 THEN {LEAST_OF} WHEN sources = 2 THEN 1 ELSE 0 END AS each_ FROM sz),
fu AS (SELECT *, 100 * ({DENSE_W}e0 / ({RRF_K} + rd) + {BM25_W}e0 / ({RRF_K} + rb)) AS combined FROM rk CROSS JOIN lim),
po AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY combined DESC, doc_id) AS pos FROM fu),
re AS (SELECT *, 0.6e0 * combined + 0.4e0 * held / n AS score FROM po WHERE pos <= {POOL}),
ok AS (SELECT *, max(CASE WHEN score >= least * {EASED}e0 THEN 1 ELSE 0 END) OVER (PARTITION BY qid) AS good FROM re),
rr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, pos) AS rank FROM ok WHERE good = 1 AND score >= least * {EASED}e0 OR good = 0 AND pos <= 3 AND score >= {RELAXED}e0 * {EASED}e0),
dv AS (SELECT *, row_number() OVER (PARTITION BY qid, source ORDER BY rank) AS nth, count(*) OVER (PARTITION BY qid, source) AS have FROM rr WHERE good = 1 OR rank = 1),
sel AS (SELECT *, CASE WHEN sources > 1 AND nth <= greatest(CASE WHEN sources > 2 THEN 3 ELSE 2 END, {floor('top_k * 1e0 / sources')}) THEN 0 ELSE 1 END AS turn FROM dv),
un AS (SELECT po.*, row_number() OVER (PARTITION BY po.qid, po.source ORDER BY po.combined DESC, po.doc_id) AS nth FROM po LEFT JOIN sel ON sel.qid = po.qid AND sel.doc_id = po.doc_id WHERE sel.qid IS NULL),
hv AS (SELECT DISTINCT qid, source, have FROM sel),
bk AS (SELECT un.* FROM un LEFT JOIN hv ON hv.qid = un.qid AND hv.source IS NOT DISTINCT FROM un.source WHERE un.nth <= un.each_ - coalesce(hv.have, 0)),
al AS (SELECT qid, doc_id, source, sim, combined, round(score, 6) AS score, CASE WHEN good = 1 THEN 'reranked' ELSE 'relaxed' END AS how, turn, CASE WHEN turn = 0 THEN 0 ELSE rank END AS a, nth, top_k, each_ FROM sel UNION ALL SELECT qid, doc_id, source, sim, combined, round(combined, 6), 'backfill', 2, 0, nth, top_k, each_ FROM bk),
li AS (SELECT *, count(*) OVER (PARTITION BY qid) AS total, row_number() OVER (PARTITION BY qid ORDER BY turn, a, source NULLS LAST, nth) AS place FROM al),
ls AS (SELECT *, CASE WHEN total > top_k AND row_number() OVER (PARTITION BY qid, source ORDER BY score DESC, place) <= each_ THEN 0 ELSE 1 END AS later, row_number() OVER (PARTITION BY qid, source ORDER BY score DESC, place) AS own FROM li),
fi AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY later, CASE WHEN later = 0 THEN source END NULLS LAST, CASE WHEN later = 0 THEN own END NULLS LAST, CASE WHEN total > top_k THEN score END DESC NULLS LAST, place) AS at_ FROM ls)
SELECT qid, doc_id, source, {d.long('at_')} AS place, round(sim, 6) AS embedding_score, round(combined, 6) AS combined, score, how FROM fi WHERE at_ <= top_k"""


def hybrid_retrieve(spark, sf_dir):
    table(spark, sf_dir, "benchmark").createOrReplaceTempView("benchmark")
    queries = spark.sql(ITEMS.format(words=SPARK.slice(t.tok_c(SPARK), "1", "12")))
    qid = dict(queries.dtypes)["qid"]
    rows = [(r.qid, r.qt) for r in queries.orderBy("qid").collect()]  # the query set
    words = sorted({w for _, q in rows for w in q})
    chunks = chunks_of(spark, sf_dir, words)
    n, avgdl, df = candidates.statistics(chunks, words)
    blocks = candidates.asked_blocks(rows, words, [float(x) for x in np.log((n - df + 0.5) / (df + 0.5) + 1)])
    how = (blocks, qid, len(words), avgdl, K1, B)
    few = stored(candidates.fused_few(chunks, *how, POOL, LEAST_OF), "few")
    sizes = spark.createDataFrame([(q, max(1, len(set(x)))) for q, x in rows], f"of_ {qid}, n int")
    ranks = candidates.ranks_of_few(chunks, *how, few).join(sizes, F.col("qid") == F.col("of_")).drop("of_")
    stored(ranks, "ranks").createOrReplaceTempView("rk")
    return spark.sql(f"WITH {retrieved(SPARK)}")


BOOK.frame("hybrid_retrieve", hybrid_retrieve, f"""
WITH {CHUNKS}, {SOURCES}, q AS ({ITEMS.format(words=DUCK.slice(t.tok_c(DUCK), '1', '12'))}), wi AS (SELECT qid, qt AS a FROM q), {vectors_of('cv', 'doc_id', 'chunks')}, {vectors_of('wv', 'qid', 'wi')},
qw AS (SELECT qid, w, count(*) AS qtf FROM (SELECT qid, unnest(qt) AS w FROM q) x GROUP BY qid, w), nq AS (SELECT qid, greatest(1, len(list_distinct(qt))) AS n FROM q),
st AS (SELECT count(*)::DOUBLE AS n, avg(len(a)) AS avgdl FROM chunks), tf AS (SELECT doc_id, dl, w, count(*)::DOUBLE AS tf FROM (SELECT doc_id, len(a)::DOUBLE AS dl, unnest(a) AS w FROM chunks) x WHERE w IN (SELECT w FROM qw) GROUP BY doc_id, dl, w),
df AS (SELECT w, count(*)::DOUBLE AS df FROM tf GROUP BY w),
raw AS (SELECT qw.qid, tf.doc_id, round(sum(qw.qtf * ln((st.n - df.df + 0.5e0) / (df.df + 0.5e0) + 1) * tf.tf * {K1 + 1}e0 / (tf.tf + {K1}e0 * (1 - {B}e0 + {B}e0 * tf.dl / st.avgdl))), 9) AS s, count(*)::DOUBLE AS held FROM qw JOIN tf ON tf.w = qw.w JOIN df ON df.w = qw.w CROSS JOIN st GROUP BY qw.qid, tf.doc_id),
pr AS (SELECT nq.qid, c.doc_id, c.source, nq.n, {COSINE} AS sim, coalesce(raw.s, 0e0) AS s, coalesce(raw.held, 0e0) AS held FROM nq JOIN wv w ON w.qid = nq.qid CROSS JOIN chunks c JOIN cv v ON v.doc_id = c.doc_id LEFT JOIN raw ON raw.qid = nq.qid AND raw.doc_id = c.doc_id),
rk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, doc_id) AS rd, row_number() OVER (PARTITION BY qid ORDER BY s DESC, doc_id) AS rb FROM pr),
{retrieved(DUCK)}""")

QUERIES, ORACLE = BOOK.queries, BOOK.oracle
