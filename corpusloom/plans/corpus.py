"""Corpus statistics, aggregations, set operations and dedup (survey sections 2.6 and 2.10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as t
from corpusloom.functions.dialect import DUCK, SPARK
from corpusloom.operators import order
from corpusloom.plans.query import Book
from corpusloom.session import stored, table

BOOK = Book()
Q = BOOK.sql


def floor_percentiles(d, table, x, points, keys=()):
    """Per group, sorted[int(p * (n - 1))]: ranks by window, then one aggregate over the ranks wanted."""
    by = f"PARTITION BY {', '.join(keys)}" if keys else ""
    head = ", ".join(keys) + ", " if keys else ""
    cols = ", ".join(f"max(CASE WHEN rn = floor({p} * (size - 1)) + 1 THEN {x} END) AS {name}" for name, p in points)
    tail = f"GROUP BY {', '.join(keys)}" if keys else ""
    return f"SELECT {head}{cols} FROM (SELECT *, row_number() OVER ({by} ORDER BY {x}) AS rn, count(*) OVER ({by}) AS size FROM {table}) r {tail}"


WORDS = lambda d: f"SELECT doc_id, lang, source, {d.long(t.n_words(d))} AS n FROM documents"
TOKENS = lambda d: f"SELECT doc_id, {d.explode(t.tok_a(d))} AS w FROM documents"
#: Some sentence is left of a text that is not all white space; in Spark without parting the text once more.
HAS_SENTENCE = lambda d: d.rx_like(t.text(d), "\\S") if d.name == "spark" else f"{d.size(t.sentences_raw(d))} > 0"
#: The pair a summary metric needs: the article and its first sentence.
PAIRS = lambda d: f"SELECT doc_id, source, lang, text AS article, {d.get(t.sentences_raw(d), 1)} AS abstract FROM documents WHERE {HAS_SENTENCE(d)}"



def by_ranges(name, build, statistics):
    """Register order statistics of the word counts of each language: in Spark by ranges, so that no task holds a language; the oracle ranks them plainly."""

    def run(spark, sf_dir):
        table(spark, sf_dir, "documents").createOrReplaceTempView("documents")
        return statistics(stored(spark.sql(WORDS(SPARK)), "words"))

    BOOK.frame(name, run, build(DUCK))


def numeric_stats(words):
    points = order.percentiles(words, "n", {"median": 0.5, "p25": 0.25, "p75": 0.75, "p95": 0.95, "p99": 0.99}, ["lang"], ("median",), "doc_id")
    plain = words.groupBy("lang").agg(F.count("*").alias("count"), F.min("n").alias("min"), F.max("n").alias("max"), F.avg("n").alias("mean"), F.stddev_pop("n").alias("std"))
    return plain.join(points, "lang")


by_ranges("numeric_stats", lambda d: f"""
WITH v AS ({WORDS(d)}), p AS ({floor_percentiles(d, 'v', 'n', (('p25', 0.25), ('p75', 0.75), ('p95', 0.95), ('p99', 0.99)), ('lang',))})
SELECT a.*, p.p25, p.p75, p.p95, p.p99 FROM (SELECT lang, count(*) AS count, min(n) AS min, max(n) AS max, avg(n) AS mean, {d.median('n', 0.5)} AS median, stddev_pop(n) AS std FROM v GROUP BY lang) a JOIN p ON a.lang = p.lang""", numeric_stats)
Q("linear_percentiles", "documents", lambda d: f"WITH v AS ({WORDS(d)}) SELECT coalesce(lang, 'all') AS split, {', '.join(f'{d.median('n', p)} AS p{int(p * 100)}' for p in (0.25, 0.5, 0.75, 0.95))}, count(*) AS n FROM v GROUP BY ROLLUP (lang)")
Q("compression_stats", "documents", lambda d: f"""
WITH p AS ({PAIRS(d)}), r AS (SELECT {d.double(t.n_words(d, 'abstract'))} / greatest(1, {t.n_words(d, 'article')}) AS r FROM p)
SELECT avg(r) AS mean_ratio, min(r) AS min_ratio, max(r) AS max_ratio, (1 - avg(r)) * 100 AS reduction_pct FROM r""")
Q("corpus_overview", "documents", lambda d: f"""
SELECT count(*) AS documents, {d.long('sum(n)')} AS words, avg(n) AS mean_words, (SELECT count(DISTINCT w) FROM ({TOKENS(d)}) k) AS vocabulary, count(DISTINCT lang) AS splits FROM ({WORDS(d)}) v""")
Q("quality_counts", "documents", lambda d: f"""
WITH v AS (SELECT doc_id, text, {d.long(t.n_words(d))} AS n, {t.fingerprint(d, 'text')} AS fp FROM documents), s AS (SELECT avg(n) AS m, stddev_pop(n) AS sd FROM v),
u AS (SELECT {d.long('coalesce(sum(c - 1), 0)')} AS duplicates FROM (SELECT fp, count(*) AS c FROM v GROUP BY fp) g WHERE c > 1)
SELECT {d.count_if('n = 0')} AS empty, {d.count_if('n < 30')} AS short, {d.count_if('n > 1500')} AS long, {d.count_if('abs(n - m) > 3 * sd')} AS outliers, max(duplicates) AS duplicates FROM v CROSS JOIN s CROSS JOIN u""")
Q("dup_count", "documents", lambda d: f"SELECT {d.long('coalesce(sum(c - 1), 0)')} AS duplicates FROM (SELECT {t.fingerprint(d, 'text')} AS fp, count(*) AS c FROM documents GROUP BY 1) g WHERE c > 1")
Q("histogram", "documents", lambda d: f"""
WITH v AS ({WORDS(d)}), b AS (SELECT CASE WHEN min(n) = max(n) THEN min(n) - 0.5e0 ELSE {d.double('min(n)')} END AS lo, CASE WHEN min(n) = max(n) THEN 1e0 ELSE {d.double('max(n) - min(n)')} END / 30 AS w FROM v),
c AS (SELECT least(floor((n - lo) / w), 29) AS bin, count(*) AS n FROM v CROSS JOIN b GROUP BY 1), g AS (SELECT {d.explode(d.seq('0', '29'))} AS bin)
SELECT {d.long('g.bin')} AS bin, lo + g.bin * w AS low, lo + (g.bin + 1) * w AS high, coalesce(c.n, 0) AS n FROM g CROSS JOIN b LEFT JOIN c ON c.bin = g.bin""")
Q("word_count_topn", "documents", lambda d: f"SELECT w AS word, count(*) AS n FROM ({TOKENS(d)}) k GROUP BY w ORDER BY n DESC, word LIMIT 100")
for n in (2, 3):
    Q(f"ngram_topn_{n}", "documents", lambda d, n=n: f"SELECT g AS gram, count(*) AS n FROM (SELECT {d.explode(d.ngrams('a', n))} AS g FROM (SELECT {t.tok_a(d)} AS a FROM documents) x) k GROUP BY g ORDER BY n DESC, gram LIMIT 30")
Q("stopword_hits", "documents", lambda d: f"SELECT w AS word, count(*) AS hits, {d.long('sum(count(*)) OVER ()')} AS total FROM ({TOKENS(d)}) k WHERE w IN ({', '.join(d.lit(x) for x in t.WATCHED_WORDS + t.STOP_WORDS)}) GROUP BY w ORDER BY hits DESC, word LIMIT 30")
Q("rare_words", "documents", lambda d: f"SELECT {d.count_if('n <= 2')} AS rare, count(*) AS vocabulary FROM (SELECT w, count(*) AS n FROM ({TOKENS(d)}) k GROUP BY w) g")
Q("zipf", "documents", lambda d: f"SELECT {d.long('rank')} AS rank, word, n, log10(rank) AS log_rank FROM (SELECT word, n, row_number() OVER (ORDER BY n DESC, word) AS rank FROM (SELECT w AS word, count(*) AS n FROM ({TOKENS(d)}) k GROUP BY w ORDER BY n DESC, word LIMIT 50) g) r")


def starts(d):
    """(doc_id, start): words before each document by id. In Spark by ranges of 10,000 ids and within them, so no task orders all rows; the oracle states it plainly."""
    if d.name != "spark":
        return "SELECT doc_id, sum(n) OVER (ORDER BY doc_id) - n AS start FROM n"
    ranges = "SELECT b AS rb, sum(c) OVER (ORDER BY b) - c AS before FROM (SELECT floor(doc_id / 10000) AS b, sum(n) AS c FROM n GROUP BY 1) g"
    return f"SELECT doc_id, before + inner_ AS start FROM (SELECT doc_id, b, sum(n) OVER (PARTITION BY b ORDER BY doc_id) - n AS inner_ FROM (SELECT doc_id, n, floor(doc_id / 10000) AS b FROM n) y) x JOIN ({ranges}) r ON b <=> rb"


#: A word's first place in a document is found before anything is joined; the join meets each document's distinct words with one number a document.
Q("vocab_growth", "documents", lambda d: f"""
WITH s AS (SELECT doc_id, {t.tok_a(d)} AS a FROM documents), n AS (SELECT doc_id, {d.long(d.size('a'))} AS n FROM s),
o AS ({starts(d)}), total AS (SELECT {d.long('sum(n)')} AS total FROM n),
p AS (SELECT doc_id, w, min(i) + 1 AS i FROM (SELECT doc_id, {d.numbered('a', 'i', 'w')} FROM s) x GROUP BY doc_id, w),
f AS (SELECT /*+ MERGE(p, o) */ w, min(start + i) AS pos FROM p JOIN o ON p.doc_id = o.doc_id GROUP BY w),
b AS (SELECT least(30, floor((pos - 1) * 30e0 / total) + 1) AS checkpoint, count(*) AS fresh FROM f CROSS JOIN total GROUP BY 1)
SELECT {d.long('checkpoint')} AS checkpoint, {d.long('sum(fresh) OVER (ORDER BY checkpoint)')} AS vocabulary FROM b""")
Q("category_counts", "documents", lambda d: "SELECT coalesce(source, 'unknown') AS category, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, category LIMIT 50")
FEATURES = lambda d: f"SELECT doc_id, {d.double('n_chars')} AS chars, {d.double(t.n_words(d))} AS words, {d.double(d.size(t.sentences_raw(d)))} AS sentences, {d.double(d.size(d.distinct(t.tok_a(d))))} AS vocab FROM documents"
NAMES = ("chars", "words", "sentences", "vocab")
Q("correlation_matrix", "documents", lambda d: f"WITH f AS ({FEATURES(d)}) SELECT {', '.join(f'round(coalesce(corr({a}, {b}), 0), 9) AS {a}_{b}' for i, a in enumerate(NAMES) for b in NAMES[i + 1 :])} FROM f")
Q("linear_regression", "documents", lambda d: f"WITH f AS ({FEATURES(d)}) SELECT round(regr_slope(sentences, words), 9) AS slope, round(regr_intercept(sentences, words), 9) AS intercept, count(*) AS n FROM f")
Q("subword_truncation", "documents", lambda d: f"WITH f AS (SELECT greatest(1, floor({d.size(t.tok_f(d))} * 1.25)) AS n FROM documents) SELECT {d.count_if('n > 1024')} AS over_1024, {d.count_if('n > 256')} AS over_256, {d.double('100')} * {d.count_if('n > 1024')} / count(*) AS pct_1024, avg(n) AS mean FROM f")
by_ranges("dataset_split_stats", lambda d: f"WITH v AS ({WORDS(d)}), p AS ({floor_percentiles(d, 'v', 'n', (('p95', 0.95),), ('lang',))}) SELECT a.lang AS split, a.n, a.mean_words, p.p95 FROM (SELECT lang, count(*) AS n, avg(n) AS mean_words FROM v GROUP BY lang) a JOIN p ON a.lang = p.lang", lambda words: words.groupBy("lang").agg(F.count("*").alias("n"), F.avg("n").alias("mean_words")).join(order.percentiles(words, "n", {"p95": 0.95}, ["lang"], tie="doc_id"), "lang").withColumnRenamed("lang", "split"))
Q("dataset_top_tokens", "documents", lambda d: f"SELECT w AS word, count(*) AS n FROM (SELECT {d.explode(d.slice(t.tok_a(d), '1', '200'))} AS w FROM (SELECT text FROM documents ORDER BY doc_id LIMIT 500) x) k GROUP BY w ORDER BY n DESC, word LIMIT 30")
Q("keywords", "documents", lambda d: f"SELECT w AS word, count(*) AS n, {d.double('count(*)')} / sum(count(*)) OVER () AS weight FROM ({TOKENS(d)}) k WHERE length(w) > 2 AND NOT {d.rx_like('w', '^[0-9]+$')} AND w NOT IN ({', '.join(d.lit(x) for x in t.STOP_WORDS)}) GROUP BY w ORDER BY n DESC, word LIMIT 20")
Q("coverage_proxy", "documents", lambda d: f"WITH p AS ({PAIRS(d)}), s AS (SELECT doc_id, article, abstract, {d.distinct(t.tok_b(d, 'article'))} AS a, {d.distinct(t.tok_b(d, 'abstract'))} AS b FROM p) SELECT doc_id, {t.ratio(d, d.size(d.intersect('a', 'b')), d.size('a'))} AS coverage, {t.ratio(d, 'length(abstract)', 'length(article)')} AS length_ratio FROM s")
Q("distinct_count", "documents", lambda d: f"SELECT lang, count(DISTINCT w) AS vocabulary FROM (SELECT lang, {d.explode(t.tok_a(d))} AS w FROM documents) k GROUP BY lang")
Q("entity_distribution", "documents", lambda d: f"SELECT kind, count(*) AS n FROM (SELECT CASE WHEN {d.rx_like('w', '^[0-9]+$')} THEN 'number' WHEN {d.rx_like('w', '^[A-ZÀ-Ý]')} THEN 'proper' ELSE 'word' END AS kind FROM (SELECT {d.explode(d.rx_all(t.text(d), t.WORD_A))} AS w FROM documents) x) y GROUP BY kind")
Q("section_rollup", "documents", lambda d: f"SELECT source AS section, count(*) AS n, md5({d.join(d.collect(t.first_words(d, 'text', 8), 'doc_id'), chr(10))}) AS summary FROM documents GROUP BY source")
Q("mean_rows", "labels", lambda d: "SELECT avg(coalesce(quality, 0)) AS quality, avg(coalesce(toxic, 0)) AS toxic, count(*) AS n FROM labels")
Q("grouping_rollup", "documents labels", lambda d: "SELECT coalesce(lang, 'all') AS split, count(*) AS n, avg(coalesce(toxic, 0)) AS toxic FROM documents JOIN labels ON documents.doc_id = labels.doc_id GROUP BY ROLLUP (lang)")

# set operations and dedup
Q("union_sources", "documents pages benchmark", lambda d: "SELECT 'document' AS kind, doc_id AS id, n_chars AS n FROM documents UNION ALL SELECT 'page', page_id, length(html) FROM pages UNION ALL SELECT 'item', item_id, length(text) FROM benchmark")
Q("intersect_tokens", "documents benchmark", lambda d: f"SELECT count(*) AS shared FROM (SELECT {d.explode(t.tok_a(d))} AS w FROM documents INTERSECT SELECT {d.explode(t.tok_a(d))} AS w FROM benchmark) x")


def except_tokens(d):
    """In Spark by one aggregate over both sides, as EXCEPT would broadcast or sort the texts' words; the oracle states it plainly."""
    a, b = (f"SELECT {d.explode(t.tok_a(d))} AS w FROM {x}" for x in ("benchmark", "documents"))
    if d.name != "spark":
        return f"SELECT w FROM ({a} EXCEPT {b}) x"
    return f"SELECT w FROM (SELECT w, 0 AS gone FROM ({a}) x UNION ALL SELECT w, 1 FROM ({b}) y) z GROUP BY w HAVING max(gone) = 0"


Q("except_tokens", "documents benchmark", except_tokens)
Q("multiset_intersect", "documents benchmark", lambda d: f"SELECT {d.long('sum(least(a.n, b.n))')} AS overlap FROM (SELECT w, count(*) AS n FROM ({TOKENS(d)}) x GROUP BY w) a JOIN (SELECT w, count(*) AS n FROM (SELECT {d.explode(t.tok_a(d))} AS w FROM benchmark) y GROUP BY w) b ON a.w = b.w")
Q("dedupe_records", "documents", lambda d: f"SELECT doc_id, fp FROM (SELECT doc_id, fp, row_number() OVER (PARTITION BY fp ORDER BY doc_id) AS nth FROM (SELECT doc_id, {t.fingerprint(d, 'text')} AS fp FROM documents) x) y WHERE nth = 1")
SENTENCES = lambda d: f"SELECT doc_id, i + 1 AS i, s FROM (SELECT doc_id, {d.numbered('a', 'i', 's')} FROM (SELECT doc_id, {t.sentences_raw(d)} AS a FROM documents) x) y"
Q("dedupe_sentences", "documents", lambda d: f"SELECT doc_id, count(*) AS n, {d.count_if('nth = 1')} AS kept FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id, substring({d.rx_rep('lower(s)', '[ ]+', ' ')}, 1, 160) ORDER BY i) AS nth FROM ({SENTENCES(d)}) s) y GROUP BY doc_id")
Q("dedupe_chunks", "documents", lambda d: f"SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS chunk_index FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(s) ORDER BY i) AS nth FROM ({SENTENCES(d)}) s) y WHERE nth = 1")
Q("consecutive_dedup", "documents", lambda d: f"SELECT doc_id, {d.count_if('prev IS NULL OR prev <> lower(s)')} AS kept FROM (SELECT doc_id, s, lag(lower(s)) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM ({SENTENCES(d)}) s) y GROUP BY doc_id")
Q("first_occurrence_dedup", "documents", lambda d: "SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS nth FROM documents) x WHERE nth = 1")
Q("element_dedupe", "documents", lambda d: f"SELECT doc_id, count(*) AS n, {d.count_if(f'nth = 1 OR w >= 80')} AS kept FROM (SELECT doc_id, {t.n_words(d, 's')} AS w, row_number() OVER (PARTITION BY doc_id, lower(s) ORDER BY i) AS nth FROM ({SENTENCES(d)}) s) y GROUP BY doc_id")
Q("remove_repeated_headers", "documents", lambda d: f"""
WITH l AS (SELECT doc_id, source, lower(trim(raw)) AS line FROM (SELECT doc_id, source, {d.explode(d.rx_split(t.text(d), '\\n'))} AS raw FROM documents) x),
c AS (SELECT source, line, count(*) AS n, min(doc_id) AS a, max(doc_id) AS z FROM l GROUP BY source, line)
SELECT source, {d.long('sum(n)')} AS kept FROM c WHERE NOT coalesce(length(line) BETWEEN 1 AND 120 AND a < z AND source IS NOT NULL, false) GROUP BY source""")
#: Words that a summariser takes at once, the default one's, and how many chunks of a document.
CHUNK_WORDS, MOST_CHUNKS = {"syllables": 307, "multilingual": 491, "other": 563}, 16


def word_chunks(d, most="multilingual"):
    """Sentences packed to a number of words, as a fold over the array of sentences; the oracle walks them by recursion. A text without sentences is one chunk."""
    size, words = CHUNK_WORDS[most], d.size(t.tok_e(d, "s"))
    s = f"SELECT doc_id, {t.text(d)} AS text, {t.sentences_raw(d)} AS a FROM documents"
    if d.name == "spark":
        start = "named_struct('done', cast(array() AS array<string>), 'cur', cast(NULL AS string), 'n', 0)"
        step = f"CASE WHEN f.cur IS NOT NULL AND f.n + {words} > {size} THEN named_struct('done', array_append(f.done, f.cur), 'cur', s, 'n', {words}) ELSE named_struct('done', f.done, 'cur', concat_ws(' ', f.cur, s), 'n', f.n + {words}) END"
        fold = f"aggregate(a, {start}, (f, s) -> {step}, f -> CASE WHEN f.cur IS NULL THEN array(text) ELSE array_append(f.done, f.cur) END)"
        return f"SELECT doc_id, posexplode(slice({fold}, 1, {MOST_CHUNKS})) AS (index, text) FROM ({s}) x"
    walk = f"SELECT w.doc_id, i + 1, CASE WHEN i > 0 AND n + c[i + 1] > {size} THEN chunk + 1 ELSE chunk END, CASE WHEN i > 0 AND n + c[i + 1] > {size} THEN c[i + 1] ELSE n + c[i + 1] END FROM w JOIN s ON s.doc_id = w.doc_id WHERE i < len(c)"
    return f"""WITH RECURSIVE s AS (SELECT doc_id, text, a, list_transform(a, lambda s: {words}) AS c FROM ({s}) x), w AS (SELECT doc_id, 0 AS i, 0 AS chunk, 0::BIGINT AS n FROM s UNION ALL {walk})
SELECT s.doc_id, chunk AS index, string_agg(a[i], ' ' ORDER BY i) AS text FROM w JOIN s ON s.doc_id = w.doc_id WHERE i > 0 AND chunk < {MOST_CHUNKS} GROUP BY s.doc_id, chunk UNION ALL SELECT doc_id, 0, text FROM s WHERE len(a) = 0"""


Q("chunk_words_sentences", "documents", word_chunks)
Q("url_dedup", "pages", lambda d: f"SELECT page_id, u FROM (SELECT page_id, u, row_number() OVER (PARTITION BY u ORDER BY page_id) AS nth FROM (SELECT page_id, {d.rx_rep('url', '[?#].*$', '')} AS u FROM pages) x) y WHERE nth = 1")


def train_val(d):
    """percent_rank by digest below 0.9. In Spark the rank is the start of the digest's range (its first twelve bits) and the rank within it, so no task orders all rows; the oracle states it plainly."""
    h = f"md5(concat('42|', {d.string('doc_id')}))"
    if d.name != "spark":
        return f"SELECT doc_id, CASE WHEN percent_rank() OVER (ORDER BY {h}) < 0.9 THEN 'train' ELSE 'val' END AS split FROM documents"
    return f"""
WITH h AS (SELECT doc_id, {h} AS h, substring({h}, 1, 3) AS b FROM documents), c AS (SELECT b, count(*) AS c FROM h GROUP BY b),
o AS (SELECT b AS ob, sum(c) OVER (ORDER BY b) - c AS start, sum(c) OVER () AS n FROM c)
SELECT doc_id, CASE WHEN (start + r - 1) / greatest(1, n - 1) < 0.9 THEN 'train' ELSE 'val' END AS split FROM (SELECT doc_id, b, rank() OVER (PARTITION BY b ORDER BY h) AS r FROM h) x JOIN o ON b <=> ob"""


Q("train_val_split", "documents", train_val)
Q("clean_dataset", "documents", lambda d: f"""
WITH c AS (SELECT doc_id, text, {t.fingerprint(d, 'text')} AS fp FROM documents WHERE length(text) >= 100 AND {d.size(t.tok_a(d))} >= 30)
SELECT doc_id, {t.first_words(d, 'text', 8)} AS title FROM (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY doc_id) AS nth FROM c) x WHERE nth = 1""")
Q("hash_sample", "documents", lambda d: f"SELECT doc_id FROM documents ORDER BY md5(concat('42|', {d.string('doc_id')})), doc_id LIMIT 50")

QUERIES, ORACLE = BOOK.queries, BOOK.oracle
