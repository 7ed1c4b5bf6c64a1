"""Similarity, scoring, evaluation, sentence graphs and vectors (survey sections 2.8, 2.11, 2.12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as t
from corpusloom.functions.dialect import DUCK, SPARK
from corpusloom.operators import likeness, order
from corpusloom.operators.overlap import overlaps
from corpusloom.plans.corpus import PAIRS, SENTENCES
from corpusloom.plans.query import Book
from corpusloom.session import spread, stored, table

BOOK = Book()
Q = BOOK.sql


def overlap(d, tok, grams=(1,), pred="abstract", ref="article"):
    """CTE s over the pairs p: for each n of ``grams`` hits{n} (clipped), np{n} and nr{n} (n-grams of each side).

    In Spark they are counted where the texts are read (see ``scored``); the oracle counts them in one aggregate, where an
    n-gram of no text, in neither side, keeps texts without words.
    """
    if d.name == "spark":
        return "s AS (SELECT * FROM overlaps)"
    side = lambda n, name, x, y: f"SELECT doc_id, {n} AS n, {d.explode(d.ngrams('a', n) if n > 1 else 'a')} AS g, {x} AS x, {y} AS y FROM (SELECT doc_id, {tok(d, name)} AS a FROM p) t"
    rows = " UNION ALL ".join([*(side(n, name, *xy) for n in grams for name, xy in ((pred, (1, 0)), (ref, (0, 1)))), "SELECT doc_id, 0, NULL, 0, 0 FROM p"])
    cols = ", ".join(f"{d.double(f'sum(CASE WHEN n = {n} THEN least(x, y) ELSE 0 END)')} AS hits{n}, {d.long(f'sum(CASE WHEN n = {n} THEN x ELSE 0 END)')} AS np{n}, {d.long(f'sum(CASE WHEN n = {n} THEN y ELSE 0 END)')} AS nr{n}" for n in grams)
    return f"s AS (SELECT doc_id, {cols} FROM (SELECT doc_id, n, g, sum(x) AS x, sum(y) AS y FROM ({rows}) u GROUP BY doc_id, n, g) c GROUP BY doc_id)"


def scored(name, tok, build, grams=(1,), pred="abstract", ref="article"):
    """Register a query over the pairs p and their ``overlap``, the CTEs that ``build`` is given."""

    def run(spark, sf_dir):
        spread(table(spark, sf_dir, "documents")).createOrReplaceTempView("documents")
        words = spark.sql(f"SELECT doc_id, {SPARK.join(tok(SPARK, pred), ' ')} AS pred, {SPARK.join(tok(SPARK, ref), ' ')} AS ref FROM ({PAIRS(SPARK)}) p")
        overlaps(words, grams).createOrReplaceTempView("overlaps")
        return spark.sql(build(SPARK, counts(SPARK)))

    counts = lambda d: f"p AS ({PAIRS(d)}), {overlap(d, tok, grams, pred, ref)}"
    BOOK.frame(name, run, build(DUCK, counts(DUCK)))


F1 = lambda h, a, b: f"CASE WHEN coalesce({h}, 0) = 0 THEN 0e0 ELSE 2 * ({h} / {a}) * ({h} / {b}) / ({h} / {a} + {h} / {b}) END"
SAME = lambda d: f"SELECT doc_id, {', '.join(f'max({x}) AS {x}' for x in ('same', 'words', 'source_words', 'sentences'))} FROM (SELECT doc_id, article = abstract AS same, {t.n_words(d, 'abstract')} AS words, {t.n_words(d, 'article')} AS source_words, {d.size(t.sentences_raw(d, 'article'))} AS sentences FROM p) z GROUP BY doc_id"
for n in (1, 2):
    scored(f"rouge{n}", t.tok_g, lambda d, c, n=n: f"WITH {c} SELECT doc_id, coalesce(hits{n} / nullif(np{n}, 0), 0) AS precision_, coalesce(hits{n} / nullif(nr{n}, 0), 0) AS recall_, {F1(f'hits{n}', f'np{n}', f'nr{n}')} AS f1 FROM s", (n,))
ROUGE1 = F1("hits1", "np1", "nr1")
scored("rouge_batch_mean", t.tok_g, lambda d, c: f"WITH {c} SELECT round(avg({ROUGE1}), 9) AS rouge1 FROM s")
scored("bleu", t.tok_a, lambda d, c: f"""
WITH {c}
SELECT doc_id, CASE WHEN np1 = 0 OR nr1 = 0 THEN 0e0 ELSE round(exp(({' + '.join(f'ln((hits{n} + 1e0) / (np{n} + 1e0))' for n in (1, 2, 3, 4))}) / 4) * CASE WHEN np1 > nr1 THEN 1e0 ELSE exp(1e0 - {d.double('nr1')} / np1) END, 9) END AS bleu FROM s""", (1, 2, 3, 4))
scored("lexical_f1", t.tok_a, lambda d, c: f"WITH {c} SELECT doc_id, {ROUGE1} AS f1 FROM s")
scored("bertscore_lex", t.tok_a, lambda d, c: f"WITH {c}, z AS ({SAME(d)}) SELECT /*+ MERGE(z) */ s.doc_id, CASE WHEN same THEN 1e0 ELSE {ROUGE1} END AS bertscore_lex FROM s JOIN z ON z.doc_id = s.doc_id")
scored("lexical_overlap", t.tok_b, lambda d, c: f"WITH {c} SELECT doc_id, CASE WHEN np1 = 0 OR nr1 = 0 THEN 0e0 ELSE hits1 / nr1 END AS overlap FROM s")
SETS = lambda d, tok: f"SELECT doc_id, article, abstract, {d.distinct(tok(d, 'article'))} AS a, {d.distinct(tok(d, 'abstract'))} AS b FROM ({PAIRS(d)}) p"
Q("jaccard", "documents", lambda d: f"WITH s AS ({SETS(d, t.tok_d)}) SELECT doc_id, {t.ratio(d, d.size(d.intersect('a', 'b')), d.size(d.union('a', 'b')))} AS jaccard FROM s")
Q("extractive_coverage", "documents", lambda d: f"WITH s AS ({SETS(d, t.tok_a)}) SELECT doc_id, {t.ratio(d, d.size(d.filter(t.tok_a(d, 'abstract'), d.has('a', 'y'), 'y')), d.size(t.tok_a(d, 'abstract')))} AS coverage, {t.ratio(d, d.size(d.filter(t.tok_a(d, 'abstract'), d.has('a', 'y'), 'y')), d.size(t.tok_a(d, 'article')))} AS density FROM s")
Q("novel_ngram_pct", "documents", lambda d: f"WITH w AS (SELECT doc_id, {t.tok_a(d, 'article')} AS a, {t.tok_a(d, 'abstract')} AS b FROM ({PAIRS(d)}) p), s AS (SELECT doc_id, {', '.join(f'{d.distinct(d.ngrams(x, n))} AS {x}{n}' for x in ('a', 'b') for n in (1, 2))} FROM w) SELECT doc_id, {', '.join(f'100 * {t.ratio(d, d.size(d.minus(f"b{n}", f"a{n}")), d.size(f"b{n}"))} AS novel{n}' for n in (1, 2))} FROM s")
Q("lead_baseline", "documents", lambda d: f"SELECT doc_id, md5({d.get(t.sentences_raw(d), 1)}) AS lead1, md5({d.join(d.slice(t.sentences_raw(d), '1', '3'), ' ')}) AS lead3, {t.first_words(d, 'text', 30)} AS lead_words FROM documents WHERE {d.size(t.sentences_raw(d))} > 0")
Q("coverage_score", "documents", lambda d: f"WITH s AS (SELECT doc_id, {d.distinct(d.filter(t.tok_a(d, 'article'), 'length(y) > 2', 'y'))} AS a, {d.distinct(d.filter(t.tok_a(d, 'abstract'), 'length(y) > 2', 'y'))} AS b FROM ({PAIRS(d)}) p) SELECT doc_id, {t.ratio(d, d.size(d.intersect('a', 'b')), d.size('a'))} AS coverage FROM s")
#: Metric columns that stand for a run's results, from the events table.
METRICS = "SELECT event_id, value / 100e0 AS rouge_l, event_id % 10 / 10e0 AS rouge2, event_id % 9 / 9e0 AS bert, event_id % 8 / 8e0 AS semantic, event_id % 7 / 7e0 AS faith, event_id % 6 / 6e0 AS cov, event_id % 5 / 5e0 AS flu, event_id % 4 / 4e0 AS comp, event_id % 3 = 0 AS biased FROM events"
CLIP = lambda x: f"greatest(0e0, least(1e0, {x}))"
COMPOSITE = CLIP("0.25e0 * rouge_l + 0.25e0 * bert + 0.20e0 * semantic + 0.15e0 * faith + 0.10e0 * cov + 0.05e0 * flu")
Q("info_retention", "events", lambda d: f"SELECT event_id, {CLIP('rouge_l * (1 + 0.25e0 * (1 - comp))')} AS retention FROM ({METRICS}) m")
Q("composite_score", "events", lambda d: f"SELECT event_id, {COMPOSITE} AS composite FROM ({METRICS}) m")
Q("combined_score", "events", lambda d: f"SELECT event_id, CASE WHEN biased THEN 0.45e0 * bert + 0.35e0 * semantic + 0.20e0 * c ELSE 0.25e0 * rouge_l + 0.15e0 * rouge2 + 0.30e0 * bert + 0.20e0 * semantic + 0.10e0 * c END AS combined FROM (SELECT *, greatest(0e0, 1e0 - abs(comp - 0.25e0) / 0.25e0) AS c FROM ({METRICS}) m) x")
Q("leaderboard_composite", "events", lambda d: f"SELECT event_id, coalesce(CASE WHEN event_id % 2 = 0 THEN bert END, {COMPOSITE}) AS composite FROM ({METRICS}) m")
Q("per_run_metrics", "events", lambda d: f"SELECT event_id, (1 - faith) * 100 AS hallucination_pct, CASE WHEN faith < 0.45e0 THEN 'high' WHEN faith < 0.7e0 THEN 'medium' ELSE 'low' END AS risk, cov / greatest(0.001e0, flu) AS throughput FROM ({METRICS}) m")
Q("format_compare_metrics", "events", lambda d: f"SELECT event_id, coalesce(nullif(rouge_l, 0), rouge2, 0) AS rouge, coalesce(nullif(bert, 0), 0) AS bertscore_f1, CASE WHEN biased THEN 'source used as reference' END AS warning FROM ({METRICS}) m")
scored("evaluate_summary", t.tok_g, lambda d, c: f"""
WITH {c}, z AS ({SAME(d)})
SELECT /*+ MERGE(z) */ s.doc_id, same AS is_biased, CASE WHEN same THEN 0e0 ELSE {ROUGE1} END AS rouge1, {t.ratio(d, 'words', 'source_words')} AS word_compression, {t.ratio(d, '1', 'sentences')} AS sentence_compression
FROM s JOIN z ON z.doc_id = s.doc_id""")


def grounding(d, source=50):
    """CTEs s, e, o, r: each of a document's last three sentences (the summary side) against its other sentences
    among the first ``source`` (the bound that the operator itself has), by Jaccard over shared terms."""
    return f"""
WITH k AS (SELECT doc_id, i, s, i > max(i) OVER (PARTITION BY doc_id) - 3 AS late FROM ({SENTENCES(d)}) x), s AS (SELECT doc_id, i, late, {d.distinct(t.tok_d(d, 's'))} AS w FROM k),
e AS (SELECT doc_id, i, late, {d.size('w')} AS n, {d.explode('w')} AS w FROM s WHERE late OR i <= {source}),
o AS (SELECT /*+ MERGE(b) */ a.doc_id, a.i, b.i AS j, count(*) AS hits, {d.double('count(*)')} / (max(a.n) + max(b.n) - count(*)) AS jac FROM e a JOIN e b ON a.doc_id = b.doc_id AND a.w = b.w AND a.late AND NOT b.late GROUP BY a.doc_id, a.i, b.i),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, i ORDER BY jac DESC, j) AS nth FROM o)"""


Q("cross_sentence_argmax", "documents", lambda d: f"{grounding(d)} SELECT doc_id, i, j, jac FROM r WHERE nth = 1")
Q("cross_sentence_chunk_topk", "documents", lambda d: f"{grounding(d)} SELECT doc_id, i, j, jac, nth AS rank FROM r WHERE nth <= 2")
Q("faithfulness", "documents", lambda d: f"{grounding(d)} SELECT s.doc_id, round(avg(coalesce(r.jac, 0)), 9) AS faithfulness, count(*) AS sentences FROM s LEFT JOIN r ON r.doc_id = s.doc_id AND r.i = s.i AND r.nth = 1 WHERE s.late GROUP BY s.doc_id")
Q("consistency_check", "documents", lambda d: f"{grounding(d)} SELECT s.doc_id, s.i, coalesce(r.jac, 0) AS score, CASE WHEN coalesce(r.jac, 0) < 0.45 THEN 'unsupported' WHEN r.jac < 0.62 THEN 'weak' ELSE 'supported' END AS status FROM s LEFT JOIN r ON r.doc_id = s.doc_id AND r.i = s.i AND r.nth = 1 WHERE s.late")
Q("hallucination_audit", "documents", lambda d: f"{grounding(d)}, a AS (SELECT s.doc_id, {d.double('count(*)')} AS n, {d.double(d.count_if('coalesce(r.jac, 0) >= 0.35'))} AS grounded FROM s LEFT JOIN r ON r.doc_id = s.doc_id AND r.i = s.i AND r.nth = 1 WHERE s.late GROUP BY s.doc_id) SELECT doc_id, grounded / n AS grounding, CASE WHEN grounded / n >= 0.75 THEN 'low' WHEN grounded / n >= 0.45 THEN 'medium' ELSE 'high' END AS risk FROM a")
Q("chat_faithfulness", "events", lambda d: f"SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 1e0 ELSE 0.35e0 * faith + 0.35e0 * cov + 0.30e0 * semantic END AS score FROM ({METRICS}) m")
Q("cross_citation", "documents", lambda d: f"{grounding(d)}, best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, i ORDER BY hits DESC, j) AS pos FROM o) SELECT doc_id, i, j AS chunk, hits FROM best WHERE pos = 1")
Q("heuristic_judge", "conversations", lambda d: f"""
WITH q AS (SELECT conv_id, turn, {d.distinct(t.tok_d(d))} AS q FROM conversations WHERE role = 'user'), a AS (SELECT conv_id, turn - 1 AS turn, {d.distinct(t.tok_d(d))} AS a FROM conversations WHERE role = 'assistant')
SELECT q.conv_id, q.turn, {t.ratio(d, d.size(d.intersect('q', 'a')), d.size('q'))} AS overlap, CASE WHEN {t.ratio(d, d.size(d.intersect('q', 'a')), d.size('q'))} < 0.15 THEN 'insufficient' ELSE 'sufficient' END AS verdict FROM q JOIN a ON q.conv_id = a.conv_id AND q.turn = a.turn""")
Q("readability", "documents", lambda d: f"SELECT doc_id, {t.ratio(d, t.n_words(d), d.size(t.sentences_raw(d)))} AS sentence_len, {t.ratio(d, d.sum(d.map(t.tok_a(d), d.double('length(v)'), 'v')), d.size(t.tok_a(d)))} AS word_len, CASE WHEN {d.size(t.tok_a(d))} = 0 THEN 0e0 ELSE 1 - {t.ratio(d, d.size(d.distinct(t.tok_a(d))), d.size(t.tok_a(d)))} END AS redundancy FROM documents")
Q("repetition_ngrams", "documents", lambda d: f"WITH g AS (SELECT doc_id, {d.ngrams('a', 3)} AS g FROM (SELECT doc_id, {t.tok_a(d)} AS a FROM documents) x) SELECT doc_id, CASE WHEN {d.size('g')} = 0 THEN 0e0 ELSE 1 - {t.ratio(d, d.size(d.distinct('g')), d.size('g'))} END AS repetition FROM g")
Q("extraction_quality", "documents", lambda d: f"""
WITH f AS (SELECT doc_id, {t.ratio(d, d.size(d.rx_all(t.text(d), '[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}_' + chr(92) + 'sÀ-ỹĐđ.,;:!?()/%+' + chr(92) + '-|]')), f'length({t.text(d)})')} AS noise, {t.single_ratio(d, t.tok_b(d))} AS single, {t.ratio(d, f'length({t.text(d)}) - length(replace({t.text(d)}, {d.nl}, {chr(39) * 2}))', d.size(t.tok_b(d)))} AS breaks, {d.size(t.tok_b(d))} AS n, {t.ratio(d, d.sum(d.map(t.tok_b(d), d.double('length(v)'), 'v')), d.size(t.tok_b(d)))} AS wl, {t.language(d, 'text')} AS lang FROM documents)
SELECT doc_id, lang, {CLIP('1e0 - least(0.35e0, noise * 3) - least(0.25e0, greatest(0e0, single - 0.18e0)) - least(0.20e0, greatest(0e0, breaks - 0.12e0)) - CASE WHEN n < 20 THEN 0.25e0 ELSE 0e0 END - CASE WHEN wl < 2.8e0 THEN 0.15e0 ELSE 0e0 END - CASE WHEN lang = {0} THEN 0.10e0 ELSE 0e0 END'.format("'unknown'"))} AS score FROM f""")
Q("selector_scores", "documents", lambda d: f"WITH p AS ({PAIRS(d)}), f AS (SELECT doc_id, {t.n_words(d, 'abstract')} AS ns, {t.n_words(d, 'article')} AS na FROM p) SELECT doc_id, {CLIP('1e0 - abs(ns - 0.25e0 * na) / greatest(1e0, 0.25e0 * na)')} AS length_score, {d.double('ns')} / greatest(1, na) AS compression FROM f")
Q("sentence_importance", "documents", lambda d: f"WITH v AS (SELECT doc_id, {d.distinct(t.tok_d(d))} AS v FROM documents), s AS (SELECT doc_id, i, {d.distinct(t.tok_d(d, 's'))} AS w FROM ({SENTENCES(d)}) x) SELECT s.doc_id, s.i, {t.ratio(d, d.size(d.intersect('w', 'v')), d.size('v'))} AS share FROM s JOIN v ON s.doc_id = v.doc_id")
#: Both sides are counted in one aggregate, as in ``overlap``; the largest count is a window over it.
Q("token_importance", "documents", lambda d: f"""
WITH p AS ({PAIRS(d)}), u AS (SELECT doc_id, {d.explode(t.tok_a(d, 'article'))} AS g, 1 AS x, 0 AS y FROM p UNION ALL SELECT doc_id, {d.explode(t.tok_a(d, 'abstract'))}, 0, 1 FROM p),
c AS (SELECT doc_id, g, sum(x) AS c, sum(y) AS y, max(sum(x)) OVER (PARTITION BY doc_id) AS top FROM u GROUP BY doc_id, g)
SELECT doc_id, g AS token, weight FROM (SELECT doc_id, g, {d.double('c')} / top AS weight, row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, g) AS nth FROM c WHERE c > 0 AND y > 0) x WHERE nth <= 40""")
Q("length_controls", "documents", lambda d: f"SELECT doc_id, greatest(1, {d.long(f'floor({t.n_words(d)} * 0.2)')}) AS target_20, least(512, greatest(32, {d.long(f'floor({t.n_words(d)} * 0.5)')})) AS target_50, CASE WHEN {t.n_words(d)} < 300 THEN 'short' WHEN {t.n_words(d)} < 1500 THEN 'medium' ELSE 'long' END AS preset FROM documents")
Q("dynamic_top_k", "conversations", lambda d: f"SELECT conv_id, turn, greatest(3, least(12, 8 + CASE WHEN {t.n_words(d)} <= 6 THEN -1 WHEN {t.n_words(d)} >= 20 THEN 1 ELSE 0 END)) AS k FROM conversations")
Q("keyword_faithfulness", "documents", lambda d: f"SELECT doc_id, least(1e0, {d.double(d.size(d.filter(d.array(*(d.lit(w) for w in ('the', 'la', 'der', 'que', 'of'))), d.has(t.tok_c(d), 'k'), 'k')))} / 5) AS score FROM documents")
Q("entities", "documents", lambda d: f"SELECT doc_id, kind, count(DISTINCT lower(e)) AS n FROM (SELECT doc_id, 'number' AS kind, {d.explode(d.rx_all(t.text(d), '[0-9]+(?:[.,][0-9]+)?'))} AS e FROM documents UNION ALL SELECT doc_id, 'proper', {d.explode(d.rx_all(t.text(d), '[A-Z][a-zà-ỹ]+(?: [A-Z][a-zà-ỹ]+)+'))} FROM documents) x GROUP BY doc_id, kind")
Q("facts", "documents", lambda d: f"SELECT doc_id, fact FROM (SELECT doc_id, fact, row_number() OVER (PARTITION BY fact ORDER BY doc_id) AS nth FROM (SELECT DISTINCT doc_id, {d.explode(d.rx_all(t.text(d), '[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]+(?:[.,][0-9]+)? ?%|[0-9]{5,}'))} AS fact FROM documents) x) y WHERE nth = 1")
Q("timeline", "documents", lambda d: f"SELECT doc_id, i, when_ FROM (SELECT doc_id, i, {d.rx_get('s', '([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{3,})', 1)} AS when_ FROM ({SENTENCES(d)}) x) y WHERE when_ <> '' ORDER BY doc_id, i LIMIT 30")

# sentence graphs
TFIDF = lambda d, of=None: f"""
s AS (SELECT doc_id, i, a, count(*) OVER (PARTITION BY doc_id) AS n FROM (SELECT doc_id, i, {t.tok_a_content(d, 's')} AS a FROM ({of or SENTENCES(d)}) x) t),
c AS (SELECT doc_id, i, w, n, count(*) AS c FROM (SELECT doc_id, i, n, {d.explode('a')} AS w FROM s) y GROUP BY doc_id, i, w, n),
f AS (SELECT doc_id, i, w, n, c, {d.double('sum(c) OVER (PARTITION BY doc_id, i)')} AS len, count(*) OVER (PARTITION BY doc_id, w) AS df FROM c),
raw AS (SELECT doc_id, i, w, c / len * (ln((1e0 + n) / (1e0 + df)) + 1) AS x FROM f),
m AS (SELECT doc_id, i, w, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id, i)) AS x FROM raw)"""  # noqa: E731  one shuffle by doc_id serves all of it, no join
COSINE = "e AS (SELECT /*+ MERGE(b) */ a.doc_id, a.i, b.i AS j, sum(a.x * b.x) AS sim FROM m a JOIN m b ON a.doc_id = b.doc_id AND a.w = b.w AND a.i < b.i GROUP BY a.doc_id, a.i, b.i)"
Q("tfidf_sentence_matrix", "documents", lambda d: f"WITH {TFIDF(d)} SELECT doc_id, i, count(*) AS terms, round(sum(x), 6) AS total FROM m GROUP BY doc_id, i")
Q("tfidf_rank", "documents", lambda d: f"WITH {TFIDF(d)}, z AS (SELECT doc_id, i, round(sum(x), 6) AS score FROM m GROUP BY doc_id, i) SELECT doc_id, i, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, i) AS rank FROM z")


def read(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


BOOK.frame("sentence_cosine", lambda s, d: likeness.pairs(read(s, d)), f"WITH {TFIDF(DUCK)}, {COSINE} SELECT doc_id, i, j, round(sim, 6) AS sim FROM e")
BOOK.frame("ranking_graph", lambda s, d: likeness.pairs(read(s, d), 0.05, 40), f"WITH {TFIDF(DUCK)}, {COSINE} SELECT doc_id, i, j, sim FROM (SELECT doc_id, i, j, round(sim, 6) AS sim, row_number() OVER (PARTITION BY doc_id ORDER BY round(sim, 6) DESC, i, j) AS nth FROM e WHERE sim > 0.05) x WHERE nth <= 40")


def explained(d):
    """The oracle of ``likeness.explanations``: ``v`` holds the scores of a row's prepared sentences, ``g1`` and so on the greedy picks, ``y`` the summary's sentences."""
    words = d.filter(t.tok_d(d, "s"), f"NOT {d.has(d.array(*(d.lit(w) for w in likeness.EXPLAIN_STOPS)), 'y')}", "y")
    bonus = "CASE list_min(list_transform(g, lambda k: abs(k - j))) WHEN 1 THEN 0.12e0 WHEN 2 THEN 0.06e0 ELSE 0e0 END"
    picks = ",".join(f"""
g{k} AS (SELECT r, was, v, list_append(g, list_position(z, list_max(z))) AS g FROM (SELECT *, list_transform(v, lambda y, j: CASE WHEN list_contains(g, j) THEN -1e0 ELSE y + {bonus} END) AS z FROM g{k - 1}) q)""" for k in range(2, likeness.SUMMARY + 1))
    keywords = f"coalesce(h.keywords, '{likeness.REASONS[2]}')"
    return f"""
WITH x AS (SELECT r, doc_id, i + 1 AS i, s, {words} AS a FROM (SELECT r, doc_id, {d.numbered('a', 'i', 's')} FROM (SELECT row_number() OVER () AS r, doc_id, {t.sentences_raw(d)} AS a FROM documents) e) f),
p AS (SELECT r AS doc_id, i AS was, s, row_number() OVER (PARTITION BY r ORDER BY i) AS i FROM (SELECT *, row_number() OVER (PARTITION BY r, substring(lower(s), 1, 160) ORDER BY i) AS nth FROM x WHERE NOT {t.editorial_line(d, 's')}) e WHERE nth = 1),
{TFIDF(d, 'SELECT doc_id, i, s FROM p')},
sc AS (SELECT p.doc_id AS r, p.i, p.was, coalesce(sum(m.x), 0e0) AS v FROM p LEFT JOIN m ON m.doc_id = p.doc_id AND m.i = p.i GROUP BY p.doc_id, p.i, p.was),
v AS (SELECT r, list(was ORDER BY i) AS was, list(CASE WHEN top > 0 THEN round(v / top, 6) ELSE 0e0 END ORDER BY i) AS v FROM (SELECT *, max(v) OVER (PARTITION BY r) AS top FROM sc) e GROUP BY r),
g1 AS (SELECT r, was, v, [list_position(v, list_max(v))] AS g FROM v),{picks},
o AS (SELECT r, list_extract(was, j) AS i FROM (SELECT r, was, unnest(list_distinct(g)) AS j FROM g{likeness.SUMMARY}) e),
u AS (SELECT x.*, coalesce(sum(CASE WHEN right(x.s, 1) IN ('.', '!', '?') THEN 1 ELSE 0 END) OVER (PARTITION BY x.r ORDER BY x.i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM x JOIN o ON o.r = x.r AND o.i = x.i),
y AS (SELECT r, doc_id, row_number() OVER (PARTITION BY r ORDER BY run) AS nth, string_agg(s, ' ' ORDER BY i) AS summary_sentence, list_distinct(flatten(list(a))) AS a FROM u GROUP BY r, doc_id, run),
k AS (SELECT r, i, w, n, count(*) AS c, min(was) AS was, count(*) OVER (PARTITION BY r, w) AS df FROM (SELECT r, i, n, generate_subscripts(a, 1) AS was, unnest(a) AS w FROM (SELECT *, count(*) OVER (PARTITION BY r) AS n FROM x) e) f GROUP BY r, i, w, n),
z AS (SELECT r, i, round(sum(ln((n + 1e0) / (df + 1e0)) + 1) + least(count(*), 30) / 30e0, 9) AS z FROM k GROUP BY r, i),
rk AS (SELECT x.r, x.i, row_number() OVER (PARTITION BY x.r ORDER BY coalesce(z.z, 0e0) DESC, x.i DESC) AS rank FROM x LEFT JOIN z ON z.r = x.r AND z.i = x.i),
h AS (SELECT r, i, string_agg(w, ', ' ORDER BY nth) AS keywords FROM (SELECT *, row_number() OVER (PARTITION BY r, i ORDER BY c DESC, was) AS nth FROM k) e WHERE nth <= {likeness.KEYWORDS} GROUP BY r, i),
b AS (SELECT y.r, y.doc_id, y.nth, y.summary_sentence, x.i, x.s, len(list_intersect(y.a, list_distinct(x.a))) AS hits, len(y.a) + len(list_distinct(x.a)) AS all_ FROM y JOIN x ON x.r = y.r),
best AS (SELECT *, row_number() OVER (PARTITION BY r, nth ORDER BY sim DESC, i) AS place FROM (SELECT *, CASE WHEN hits = 0 THEN 0e0 ELSE {d.double('hits')} / (all_ - hits) END AS sim FROM b) e)
SELECT best.doc_id, best.nth, best.summary_sentence, best.i, best.s AS sentence, rk.rank AS importance_rank, round(best.sim, 4) AS similarity, coalesce(h.keywords, '') AS keywords,
  CASE WHEN rk.rank <= {likeness.HIGH} THEN format({d.lit(likeness.REASONS[0])}, {keywords}) ELSE format({d.lit(likeness.REASONS[1])}, best.sim, {keywords}) END AS reason
FROM best JOIN rk ON rk.r = best.r AND rk.i = best.i LEFT JOIN h ON h.r = best.r AND h.i = best.i WHERE best.place = 1"""


BOOK.frame("extractive_explanations", lambda s, d: likeness.explanations(read(s, d)), explained(DUCK))


Q("prepare_sentences", "documents", lambda d: f"SELECT doc_id, i, s FROM (SELECT doc_id, i, s, row_number() OVER (PARTITION BY doc_id, substring(lower(s), 1, 160) ORDER BY i) AS nth FROM ({SENTENCES(d)}) x WHERE NOT {t.editorial_line(d, 's')}) y WHERE nth = 1")
Q("chunk_graph", "documents", lambda d: f"SELECT doc_id, i AS source_, nxt AS target_ FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM ({SENTENCES(d)}) x) y WHERE nxt IS NOT NULL")
#: Entities and keywords of a graph, and the weight of an edge between entities.
MOST_ENTITIES, MOST_KEYWORDS, ENTITY_WEIGHT = 30, 8, 0.4


def entity_graph(d):
    """Edges of each document's graph: from its first entity to the others and to its keywords. Entities by how often they occur, then by name; a keyword weighs its share of the words."""
    number, proper = "[0-9]+(?:[.,][0-9]+)?", "[A-Z][a-zà-ỹ]+(?: [A-Z][a-zà-ỹ]+)+"
    return f"""
WITH e AS (SELECT doc_id, label, kind, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, label, kind) AS nth FROM (SELECT doc_id, label, kind, count(*) AS n FROM (
  SELECT doc_id, {d.explode(d.rx_all(t.text(d), number))} AS label, 'number' AS kind FROM documents UNION ALL SELECT doc_id, {d.explode(d.rx_all(t.text(d), proper))}, 'proper' FROM documents) x GROUP BY doc_id, label, kind) y),
c AS (SELECT doc_id, w, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, w) AS nth, {d.double('n')} / sum(n) OVER (PARTITION BY doc_id) AS share FROM (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, {d.explode(t.tok_a_content(d))} AS w FROM documents) z WHERE length(w) > 2 GROUP BY doc_id, w) k),
n AS (SELECT doc_id, nth AS place, label, kind, {ENTITY_WEIGHT}e0 AS weight FROM e WHERE nth <= {MOST_ENTITIES} UNION ALL SELECT doc_id, {MOST_ENTITIES} + nth, w, 'concept', round(share, 9) FROM c WHERE nth <= {MOST_KEYWORDS}),
h AS (SELECT *, first_value(label) OVER (PARTITION BY doc_id ORDER BY place) AS head, first_value(place) OVER (PARTITION BY doc_id ORDER BY place) AS first FROM n)
SELECT doc_id, head AS source_, label AS target_, kind, weight FROM h WHERE place > first OR kind = 'concept'"""


Q("entity_graph", "documents", entity_graph)
Q("mindmap", "documents", lambda d: f"SELECT source AS parent, w AS child, n FROM (SELECT source, w, n, row_number() OVER (PARTITION BY source ORDER BY n DESC, w) AS nth FROM (SELECT source, w, count(*) AS n FROM (SELECT source, {d.explode(t.tok_d(d))} AS w FROM documents) x WHERE length(w) > 3 GROUP BY source, w) y) z WHERE nth <= 6")

# vectors
DOT = lambda d, a, b: f"aggregate(zip_with({a}, {b}, (p, q) -> cast(p as double) * cast(q as double)), 0D, (s, y) -> s + y)" if d.name == "spark" else f"list_inner_product({a}::DOUBLE[], {b}::DOUBLE[])"
COS = lambda d, a, b: f"{DOT(d, a, b)} / nullif(sqrt({DOT(d, a, a)}) * sqrt({DOT(d, b, b)}), 0)"
Q("vector_topk", "embeddings", lambda d: f"SELECT vec_id, round(sim, 9) AS sim FROM (SELECT e.vec_id, {COS(d, 'e.embedding', 'q.v')} AS sim FROM embeddings e CROSS JOIN (SELECT embedding AS v FROM embeddings WHERE vec_id = 0) q WHERE e.vec_id <> 0) x ORDER BY sim DESC, vec_id LIMIT 10")
Q("dense_scores", "embeddings", lambda d: f"SELECT e.vec_id, round({COS(d, 'e.embedding', 'q.v')}, 9) AS score FROM embeddings e CROSS JOIN (SELECT embedding AS v FROM embeddings WHERE vec_id = 1) q")
Q("heatmap", "embeddings", lambda d: f"WITH f AS (SELECT vec_id, embedding FROM embeddings ORDER BY vec_id LIMIT 24) SELECT a.vec_id AS x, b.vec_id AS y, round({COS(d, 'a.embedding', 'b.embedding')}, 9) AS sim FROM f a JOIN f b ON a.vec_id < b.vec_id")


def neighbours(spark, sf_dir):
    """(label, vec_id, rank, sim): each vector with the cosine to the one before it in its label, null at the first; no task holds a label."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    ranked = stored(order.numbered(vectors, [F.col("vec_id")], ["label"]), "ranked")
    return order.with_previous(ranked, ["label"], {"embedding": "prev"}).selectExpr("label", "vec_id", "rank", f"{COS(SPARK, 'embedding', 'prev')} AS sim")


def adjacent_coherence(spark, sf_dir):
    pairs = neighbours(spark, sf_dir).where("rank > 1")
    return pairs.groupBy("label").agg(F.round(F.avg("sim"), 9).alias("mean_sim"), F.round(F.min("sim"), 9).alias("min_sim"))


def semantic_breakpoints(spark, sf_dir):
    """Vectors of each label farther from the one before than the label's mean and 0.8 standard deviations."""
    pairs = stored(neighbours(spark, sf_dir).where("rank > 1").selectExpr("label", "1 - sim AS dist"), "distances")
    cuts = pairs.groupBy(F.col("label").alias("of")).agg((F.avg("dist") + 0.8 * F.stddev_pop("dist")).alias("cut"))
    return pairs.join(cuts, F.col("label") == F.col("of")).groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("dist") > F.col("cut")).alias("breaks"))


def semantic_group(spark, sf_dir):
    """Groups of consecutive vectors of a label; one begins where the cosine to the one before falls under 0.1."""
    begins = F.when((F.col("rank") == 1) | (F.col("sim") < 0.1), 1).otherwise(0)
    return order.running_sum(neighbours(spark, sf_dir), begins, ["label"], "grp").select("label", "vec_id", F.col("grp").cast("long").alias("grp"))


#: The oracles state these with windows over a label.
WINDOWED = {
    "adjacent_coherence": lambda d: f"SELECT label, round(avg(sim), 9) AS mean_sim, round(min(sim), 9) AS min_sim FROM (SELECT label, {COS(d, 'embedding', 'nxt')} AS sim FROM (SELECT label, embedding, lead(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS nxt FROM embeddings) x WHERE nxt IS NOT NULL) y GROUP BY label",
    "semantic_breakpoints": lambda d: f"WITH a AS (SELECT label, vec_id, 1 - {COS(d, 'embedding', 'nxt')} AS dist FROM (SELECT label, vec_id, embedding, lead(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS nxt FROM embeddings) x WHERE nxt IS NOT NULL), s AS (SELECT label, avg(dist) + 0.8e0 * stddev_pop(dist) AS cut FROM a GROUP BY label) SELECT a.label, count(*) AS n, {d.count_if('dist > cut')} AS breaks FROM a JOIN s ON a.label = s.label GROUP BY a.label",
    "semantic_group": lambda d: f"SELECT label, vec_id, {d.long('sum(brk) OVER (PARTITION BY label ORDER BY vec_id)')} AS grp FROM (SELECT label, vec_id, CASE WHEN prev IS NULL OR {COS(d, 'embedding', 'prev')} < 0.1 THEN 1 ELSE 0 END AS brk FROM (SELECT label, vec_id, embedding, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS prev FROM embeddings) x) y",
}
for run in (adjacent_coherence, semantic_breakpoints, semantic_group):
    BOOK.frame(run.__name__, run, WINDOWED[run.__name__](DUCK))

QUERIES, ORACLE = BOOK.queries, BOOK.oracle
