"""Sources, sinks, joins, windows, sorts, runs and dashboards (survey sections 2.1, 2.5 to 2.8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as t
from corpusloom.functions.dialect import DUCK
from corpusloom.operators import order
from corpusloom.plans.corpus import SENTENCES
from corpusloom.plans.query import Book
from corpusloom.session import table

BOOK = Book()
Q = BOOK.sql
#: Fixed value: the moment that relative ranges count from.
NOW = "TIMESTAMP '2024-01-31 00:00:00'"
#: Runs drawn from the events table: an algorithm, a day, a score, a latency.
RUNS = "SELECT event_id AS run_id, ts AS created_at, event_type AS algorithm, user_id, value, value / 100.0e0 AS rouge_l, event_id % 7 * 0.5e0 AS latency FROM events"

# scans and sinks
Q("src_split_cap", "documents", lambda d: "SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS nth FROM documents WHERE trim(coalesce(text, '')) <> '') x WHERE nth <= 25")
Q("src_link_pages", "pages", lambda d: f"""
WITH l AS (SELECT page_id, i, {d.get('a', 'i')} AS link FROM (SELECT page_id, a, {d.explode(d.seq('1', d.size('a')))} AS i FROM (SELECT page_id, {d.rx_all('html', 'href="/[^"]*"')} AS a FROM pages) x) y)
SELECT link, first_page, n FROM (SELECT link, min(page_id) AS first_page, count(*) AS n FROM l WHERE length(link) > 10 GROUP BY link) z ORDER BY first_page, link LIMIT 200""")
Q("src_chunks_join", "documents benchmark", lambda d: "SELECT x.doc_id, x.source, b.item_id FROM documents x JOIN benchmark b ON x.doc_id = b.item_id WHERE x.source IN ('src0', 'src1', 'src2') ORDER BY x.source, x.doc_id")
UPSERT = lambda new: f"SELECT id, version, n FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY version DESC) AS nth FROM (SELECT doc_id AS id, 1 AS version, n_chars AS n FROM documents UNION ALL {new}) u) r WHERE nth = 1"
Q("sink_upsert", "documents benchmark", lambda d: UPSERT("SELECT item_id, 2, length(text) FROM benchmark"))
Q("sink_upsert_vectors", "embeddings", lambda d: f"SELECT id, label FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY version DESC) AS nth FROM (SELECT vec_id AS id, 1 AS version, label, {d.size('embedding')} AS dim FROM embeddings UNION ALL SELECT vec_id * 2, 2, label + 100, CASE WHEN vec_id % 3 = 0 THEN 8 ELSE {d.size('embedding')} END FROM embeddings) u WHERE dim = 64) r WHERE nth = 1")
Q("sink_delete_cascade", "documents labels", lambda d: "SELECT doc_id, quality FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents x WHERE x.source = 'src1' AND x.doc_id = l.doc_id)")
Q("sink_delete_vectors", "embeddings", lambda d: "SELECT vec_id, label FROM embeddings e WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT vec_id AS v FROM embeddings WHERE label = 3) g WHERE g.v = e.vec_id)")

# joins
Q("join_inner_eq", "orders customer", lambda d: "SELECT o_orderkey, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 200000")
Q("join_left_agg", "customer orders", lambda d: "SELECT c.c_custkey, coalesce(o.n, 0) AS n, coalesce(o.total, 0) AS total FROM customer c LEFT JOIN (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey) o ON c.c_custkey = o.o_custkey")
Q("join_left_distinct_like", "conversations", lambda d: "SELECT DISTINCT conv_id FROM conversations WHERE lower(text) LIKE '%the%' OR lower(role) LIKE '%sys%' ORDER BY conv_id LIMIT 40 OFFSET 5")
Q("subquery_correlated_count", "documents labels", lambda d: "SELECT doc_id, coalesce(n, 0) AS n FROM documents x LEFT JOIN (SELECT doc_id AS id, count(*) AS n FROM labels GROUP BY doc_id) l ON x.doc_id = l.id")
Q("join_anti", "customer orders", lambda d: "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")
Q("join_semi", "documents labels", lambda d: "SELECT doc_id, source FROM documents x WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = x.doc_id AND l.quality = 1)")
Q("dict_lookup", "nation region customer", lambda d: "SELECT r_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
Q("resolve_page", "documents", lambda d: f"WITH p AS (SELECT doc_id, substring(trim(text), 200, 30) AS head, {t.sentences_raw(d)} AS a FROM documents WHERE length(text) > 400) SELECT doc_id, min(i + 1) AS page FROM (SELECT doc_id, head, {d.numbered('a', 'i', 's')} FROM p) x WHERE {d.pos('head', 's')} > 0 GROUP BY doc_id")
Q("self_adjacent", "documents", lambda d: f"SELECT doc_id, i, {d.size(d.intersect(d.distinct(t.tok_d(d, 's')), d.distinct(t.tok_d(d, 'nxt'))))} AS shared FROM (SELECT doc_id, i, s, lead(s) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM ({SENTENCES(d)}) x) y WHERE nxt IS NOT NULL")
Q("cross_alg_metrics", "lineitem", lambda d: f"SELECT metric, avg(v) AS mean, count(*) AS n FROM (SELECT 'quantity' AS metric, l_quantity AS v FROM lineitem UNION ALL SELECT 'discount', l_discount FROM lineitem UNION ALL SELECT 'tax', l_tax FROM lineitem) x GROUP BY metric".replace("avg(v)", "round(avg(v), 9)"))

# windows and ranking


def rank_results(spark, sf_dir):
    """All runs in order; in Spark by ranges, the oracle by one window."""
    table(spark, sf_dir, "events").createOrReplaceTempView("events")
    runs = spark.sql(RUNS)
    ranked = order.numbered(runs, [F.when(F.col("algorithm") == "view", 1).otherwise(0), F.desc("rouge_l"), F.col("latency"), F.col("run_id")])
    return ranked.select("run_id", "algorithm", "rank")


BOOK.frame("rank_results", rank_results, f"SELECT run_id, algorithm, {DUCK.long('row_number() OVER (ORDER BY CASE WHEN algorithm = {0} THEN 1 ELSE 0 END, rouge_l DESC, latency, run_id)'.format(DUCK.lit('view')))} AS rank FROM ({RUNS}) r")
Q("per_doc_topk", "documents", lambda d: f"SELECT doc_id, i, words FROM (SELECT doc_id, i, words, row_number() OVER (PARTITION BY doc_id ORDER BY words DESC, i) AS nth FROM (SELECT doc_id, i, {d.long(t.n_words(d, 's'))} AS words FROM ({SENTENCES(d)}) x) y) z WHERE nth <= 3")
Q("topn_per_model", "events", lambda d: f"SELECT algorithm, run_id, rouge_l FROM (SELECT *, row_number() OVER (PARTITION BY algorithm ORDER BY rouge_l DESC, run_id) AS nth FROM ({RUNS}) r) x WHERE nth <= 5")
Q("argmax_group", "events", lambda d: f"SELECT algorithm, run_id AS best FROM (SELECT *, row_number() OVER (PARTITION BY algorithm ORDER BY rouge_l DESC, latency, run_id) AS nth FROM ({RUNS}) r) x WHERE nth = 1")
#: The document's sentence count and a word's sentence count are windows over the sentences' words: one shuffle by document, no join.
Q("importance_rank", "documents", lambda d: f"""
WITH s AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id) AS n, {d.distinct(t.tok_d(d, 's'))} AS w FROM ({SENTENCES(d)}) x), e AS (SELECT doc_id, i, n, {d.explode('w')} AS w FROM s),
f AS (SELECT doc_id, i, n, count(*) OVER (PARTITION BY doc_id, w) AS df FROM e),
z AS (SELECT doc_id, i, round(sum(ln((1e0 + n) / (1e0 + df)) + 1), 6) AS score FROM f GROUP BY doc_id, i)
SELECT doc_id, i, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, i DESC) AS rank FROM z""")

# sorts, limits, paging
Q("order_limit", "orders", lambda d: "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
Q("limit_offset", "orders", lambda d: "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 40")
Q("page_of", "documents", lambda d: "WITH f AS (SELECT doc_id FROM documents WHERE lang = 'en' AND lower(text) LIKE '%the%') SELECT p.doc_id, c.total, ceil(c.total / 10e0) AS pages FROM (SELECT doc_id FROM f ORDER BY doc_id LIMIT 10 OFFSET 10) p CROSS JOIN (SELECT count(*) AS total FROM f) c")
Q("latest_per_key", "orders", lambda d: "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS nth FROM orders) x WHERE nth = 1")
Q("activity_feed", "documents pages events", lambda d: f"SELECT kind, id, at_ FROM (SELECT 'run' AS kind, event_id AS id, {d.string('ts')} AS at_ FROM events UNION ALL SELECT 'document', doc_id, '2024-01-15 12:00:00' FROM documents UNION ALL SELECT 'page', page_id, '2024-01-20 08:00:00' FROM pages) x ORDER BY at_ DESC, kind, id LIMIT 15")
Q("recent_runs", "events", lambda d: f"SELECT run_id, algorithm FROM ({RUNS}) r ORDER BY created_at DESC, run_id LIMIT 20")

# runs, leaderboards, dashboards
AVG = lambda x: f"round(avg({x}), 9)"  # noqa: E731  sums of doubles depend on their order
Q("leaderboard", "events", lambda d: f"SELECT algorithm, count(*) AS n, {AVG('rouge_l')} AS rouge_l, {AVG('latency')} AS latency, round({d.double('100')} * {d.count_if('rouge_l < 0.45')} / count(*), 9) AS hallucination_pct FROM ({RUNS}) r GROUP BY algorithm")
Q("leaderboard_by_category", "events", lambda d: f"SELECT algorithm, user_id % 4 AS category, count(*) AS n, {AVG('rouge_l')} AS rouge_l FROM ({RUNS}) r GROUP BY algorithm, user_id % 4")
Q("group_summary", "events", lambda d: f"SELECT CASE WHEN algorithm IN ('click', 'view') THEN 'extractive' ELSE 'abstractive' END AS grp, count(*) AS n, {AVG('rouge_l')} AS rouge_l, {AVG('latency')} AS latency FROM ({RUNS}) r GROUP BY 1")
Q("dashboard_metrics", "events", lambda d: f"SELECT count(*) AS runs, count(DISTINCT algorithm) AS models, {AVG('nullif(rouge_l, 0)')} AS rouge_l, {AVG('nullif(latency, 0)')} AS latency FROM ({RUNS}) r WHERE created_at IS NULL OR created_at >= TIMESTAMP '2024-01-01 00:00:00'")
Q("model_performance", "events", lambda d: f"SELECT algorithm, count(*) AS n, {AVG('rouge_l')} AS rouge_l, {AVG('latency')} AS latency FROM ({RUNS}) r GROUP BY algorithm ORDER BY rouge_l DESC, algorithm LIMIT 10")
Q("daily_timeseries", "events", lambda d: f"SELECT {d.date('coalesce(created_at, ' + NOW + ')')} AS day, count(*) AS runs, round(avg(m), 9) AS rouge_l FROM (SELECT user_id, created_at, avg(rouge_l) AS m FROM ({RUNS}) r GROUP BY user_id, created_at) u GROUP BY 1")
Q("benchmark_progress", "events", lambda d: f"SELECT algorithm, count(*) AS done, 5000 - count(*) AS remaining, {AVG('latency')} AS latency, round(avg(latency) * greatest(0, 5000 - count(*)), 6) AS eta_s FROM ({RUNS}) r GROUP BY algorithm")
Q("eval_algorithm", "events", lambda d: f"SELECT algorithm, {d.count_if('value IS NOT NULL')} AS valid, {d.count_if('value IS NULL OR value < 0')} AS errors, round(sum(coalesce(rouge_l, 0)) / greatest(1, count(*)), 9) AS rouge_l FROM ({RUNS}) r GROUP BY algorithm")
Q("stage_timer_report", "events", lambda d: f"SELECT algorithm AS stage, round(sum(latency), 6) AS seconds, round({d.double('100')} * sum(latency) / sum(sum(latency)) OVER (), 9) AS pct FROM ({RUNS}) r GROUP BY algorithm")
Q("grid_search_best", "events", lambda d: f"SELECT config, recall, ndcg FROM (SELECT user_id % 9 AS config, {AVG('rouge_l')} AS recall, {AVG('latency')} AS ndcg FROM ({RUNS}) r GROUP BY user_id % 9) g ORDER BY recall DESC, ndcg DESC, config LIMIT 1")
Q("research_matrix", "events", lambda d: f"SELECT algorithm, rouge_l, latency, round((rouge_l + latency) / 2, 6) AS mean FROM (SELECT algorithm, {AVG('rouge_l')} AS rouge_l, {AVG('latency')} AS latency FROM ({RUNS}) r GROUP BY algorithm) g")
Q("chart_payloads", "events", lambda d: f"SELECT algorithm, 'rouge_l' AS metric, {AVG('rouge_l')} AS v FROM ({RUNS}) r GROUP BY algorithm UNION ALL SELECT algorithm, 'latency', {AVG('latency')} FROM ({RUNS}) r GROUP BY algorithm")
Q("props_json", "events", lambda d: f"SELECT event_id, length(props) AS n, {d.rx_get('props', chr(34) + '([a-z_]+)' + chr(34), 1)} AS first_key FROM events")
Q("overview_aggregates", "documents conversations events", lambda d: "SELECT a.documents, b.sessions, c.runs FROM (SELECT count(*) AS documents FROM documents) a CROSS JOIN (SELECT count(DISTINCT conv_id) AS sessions FROM conversations) b CROSS JOIN (SELECT count(*) AS runs FROM events) c")
Q("dashboard_search", "documents conversations pages", lambda d: """
SELECT kind, id, field FROM (
SELECT 'document' AS kind, doc_id AS id, CASE WHEN lower(source) LIKE '%src1%' THEN 'source' WHEN lower(text) LIKE '%idiot%' THEN 'text' END AS field FROM documents
UNION ALL SELECT 'message', conv_id * 1000 + turn, CASE WHEN lower(role) LIKE '%src1%' THEN 'role' WHEN lower(text) LIKE '%idiot%' THEN 'text' END FROM conversations
UNION ALL SELECT 'page', page_id, CASE WHEN lower(url) LIKE '%idiot%' THEN 'url' WHEN lower(html) LIKE '%idiot%' THEN 'html' END FROM pages) x WHERE field IS NOT NULL""")
Q("missing_doc_coverage", "documents labels", lambda d: "SELECT doc_id FROM documents x WHERE x.source IN ('src1', 'src2') AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = x.doc_id)")
Q("format_history", "conversations", lambda d: f"SELECT conv_id, md5({d.join(d.collect('line', 'turn'), chr(10))}) AS history FROM (SELECT conv_id, turn, concat(role, ': ', text) AS line, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS nth FROM conversations) x WHERE nth <= 4 GROUP BY conv_id")
Q("format_by_document", "documents", lambda d: f"SELECT source, md5({d.join(d.collect('concat({0}, doc_id, {1}, substring(text, 1, 80))'.format(d.lit('['), d.lit('] ')), 'doc_id'), chr(10))}) AS passages FROM documents GROUP BY source")
Q("message_counts", "conversations", lambda d: "SELECT conv_id, role, count(*) AS n, max(turn) AS last_turn FROM conversations GROUP BY conv_id, role")

QUERIES, ORACLE = BOOK.queries, BOOK.oracle
