"""Text queries: cleaning, tokenizers, sentences, hashes, predicates (survey sections 2.2 to 2.4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import letters
from corpusloom.functions import text as t
from corpusloom.functions.dialect import SPARK
from corpusloom.plans.query import Book
from corpusloom.session import stored, table

BOOK = Book()
P = BOOK.project

# cleaning scalars
P("fix_decimal_spacing", value=lambda d: t.fix_decimals(d, "concat(n_chars, '. ', n_chars % 7, ' x ', n_chars % 5, ' - ', n_chars % 3, ' , 2')"))
P("normalize_punct", value=lambda d: f"md5({t.punctuation(d, t.text(d))})", sample=lambda d: t.punctuation(d, "concat('“a”!!?? b,,c…d ;e', n_chars, ' .')"))
P("strip_noise", value=lambda d: f"md5({t.noise(d, t.text(d))})")
P("normalize_ws", value=lambda d: f"md5({t.white_space(d, t.text(d))})")
P("clean_text", value=lambda d: f"md5({t.clean(d, 'text')})", n=lambda d: f"length({t.clean(d, 'text')})")
P("strip_html_regex", "pages", "page_id", value=lambda d: f"md5({t.strip_tags(d, t.text(d, 'html'))})")
P("strip_url_email", "pages", "page_id", value=lambda d: t.strip_urls(d, "concat(coalesce(url, ''), ' a@b.co end')"))
P("dehyphenate", value=lambda d: f"md5({t.dehyphenate(d, d.rx_rep(t.text(d), ' ', '-' + chr(10)))})")
P("trim_incomplete", value=lambda d: f"md5({t.trim_incomplete(d, 'concat(text, {0})'.format(d.lit(' and so on')))})")
P("truncate_words", value=lambda d: t.first_words(d, "text", 12))
P("safe_filename", "pages", "page_id", value=lambda d: t.safe_filename(d, t.text(d, "url")))
P("prompt_leak_strip", "conversations", "conv_id, turn", value=lambda d: f"md5({d.rx_rep(t.text(d), '(?i)^(user|assistant|system) *:', '')})", changed=lambda d: d.rx_like(t.text(d), "(?i)^(user|assistant|system) *:"))
P("search_snippet", value=lambda d: f"CASE WHEN {d.pos(d.lit('the'), f'lower({t.text(d)})')} = 0 THEN NULL ELSE concat(CASE WHEN {d.pos(d.lit('the'), f'lower({t.text(d)})')} > 49 THEN '…' ELSE '' END, substring(text, greatest(1, {d.pos(d.lit('the'), f'lower({t.text(d)})')} - 48), least({d.pos(d.lit('the'), f'lower({t.text(d)})')} - 1, 48) + 51), CASE WHEN {d.pos(d.lit('the'), f'lower({t.text(d)})')} + 50 < length(text) THEN '…' ELSE '' END) END")
BOOK.sql("trim_word_budget", "documents", lambda d: f"""
WITH s AS (SELECT doc_id, i, {d.get('a', 'i')} AS s FROM (SELECT doc_id, a, {d.explode(d.seq('1', d.size('a')))} AS i FROM (SELECT doc_id, {t.sentences_raw(d)} AS a FROM documents) x) y),
c AS (SELECT doc_id, i, sum({t.n_words(d, 's')}) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS words FROM s)
SELECT doc_id, {d.count_if('i = 1 OR words <= 60')} AS sentences FROM c GROUP BY doc_id""")
BOOK.sql("strip_editorial", "documents", lambda d: f"""
WITH l AS (SELECT doc_id, i, trim({d.get(d.rx_split(t.text(d), '[\\r\\n]+'), 'i')}) AS line FROM (SELECT doc_id, text, {d.explode(d.seq('1', d.size(d.rx_split(t.text(d), '[\\r\\n]+'))))} AS i FROM documents) s),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, {t.headline_key(d, 'line')}, length(line) < 140 ORDER BY i) AS nth FROM l WHERE NOT {t.editorial_line(d, 'line')})
SELECT doc_id, count(*) AS n, md5({d.join(d.collect('line', 'i'), chr(10))}) AS value FROM k WHERE nth = 1 OR length(line) >= 140 GROUP BY doc_id""")
BOOK.sql("merge_texts", "conversations", lambda d: f"SELECT conv_id, md5({d.join(d.collect('trim(text)', 'turn'), chr(10) * 2)}) AS value FROM conversations WHERE trim(coalesce(text, '')) <> '' GROUP BY conv_id")
BOOK.sql("excerpt", "documents benchmark", lambda d: f"""
WITH q AS (SELECT {d.distinct(t.tok_c(d, 'text'))} AS q FROM benchmark WHERE item_id = 0),
s AS (SELECT doc_id, i, {d.get('a', 'i')} AS s FROM (SELECT doc_id, a, {d.explode(d.seq('1', d.size('a')))} AS i FROM (SELECT doc_id, {t.sentences_c(d)} AS a FROM documents) x) y),
o AS (SELECT doc_id, i, s, {d.size(d.intersect(d.distinct(t.tok_c(d, 's')), 'q'))} AS hits FROM s CROSS JOIN q),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, i) AS nth FROM o)
SELECT doc_id, substring(s, 1, 420) AS value, {d.long('hits')} AS hits FROM r WHERE nth = 1""")
P("conversation_title", "conversations", "conv_id, turn", value=lambda d: f"substring(trim({d.rx_rep(d.rx_rep(t.text(d), '[?!.]+', ''), chr(92) + 's+', ' ')}), 1, 60)")
BOOK.sql("cleaning_effect", "documents", lambda d: f"""
WITH c AS (SELECT lang, {t.n_words(d)} AS raw, {t.n_words(d, t.clean(d, 'text'))} AS kept, {d.size(t.sentences_raw(d))} AS s0, {d.size(t.sentences_a(d))} AS s1 FROM documents)
SELECT lang, {d.long('sum(raw)')} AS raw_words, {d.long('sum(kept)')} AS clean_words, {d.long('sum(s0)')} AS raw_sentences, {d.long('sum(s1)')} AS clean_sentences, {d.double('100')} * (sum(raw) - sum(kept)) / greatest(1, sum(raw)) AS loss_pct FROM c GROUP BY lang""")
#: Texts are cleaned once in Spark, words and sentences made of that.
CLEANED = "SELECT doc_id, {text} AS s, {clean} AS c FROM documents".format(text=t.text(SPARK), clean=t.clean(SPARK, "text"))
P("preprocess_report", n_sentences=lambda d: d.long(d.size(t.sentences_a(d))), garbled=lambda d: t.garbled_single(d, t.clean(d, "text")), has_control=lambda d: d.rx_like(t.text(d), "[\\x00-\\x08]"))
BOOK.queries["preprocess_report"] = BOOK.statement("documents", f"""
SELECT doc_id, n_sentences, ({t.single_ratio(SPARK, 'w')} >= 0.15) AS garbled, has_control
FROM (SELECT doc_id, {SPARK.long(SPARK.size(t.sentences_raw(SPARK, 'c')))} AS n_sentences, {t.tok_a(SPARK, 'c')} AS w, {SPARK.rx_like('s', '[' + chr(92) + 'x00-' + chr(92) + 'x08]')} AS has_control FROM ({CLEANED}) x) y""")

# tokenizers, sentences, hashes
for name, tok in {"tokenize_vi": t.tok_a, "tokenize_vi_content": t.tok_a_content, "tokenize_unicode": t.tok_b, "tokenize_retrieval": t.tok_c, "tokenize_fact": t.tok_d, "tokenize_rouge": t.tok_g, "split_sentences_a": t.sentences_a, "split_sentences_b": t.sentences_b, "split_sentences_c": t.sentences_c}.items():
    P(name, n=lambda d, tok=tok: d.long(d.size(tok(d))), value=lambda d, tok=tok: f"md5({d.join(tok(d), '|')})")
P("count_words", n=lambda d: d.long(t.n_words(d)))
P("count_tokens_est", n=lambda d: d.long(f"greatest(1, floor({d.size(t.tok_f(d))} * 1.25))"))
P("estimate_tokens_chars", n=lambda d: d.long(f"greatest(1, floor(length({t.text(d)}) / 3.5))"))
P("sentence_count", n=lambda d: d.long(d.size(t.sentences_a(d))), paragraphs=lambda d: d.long(d.size(d.filter(d.rx_split(t.text(d), "\\n\\s*\\n"), "trim(x) <> ''"))))
BOOK.sql("ngrams", "documents", lambda d: f"SELECT doc_id, md5({d.join('g2', '|')}) AS bigrams, md5({d.join('g3', '|')}) AS trigrams FROM (SELECT doc_id, {d.ngrams('a', 2)} AS g2, {d.ngrams('a', 3)} AS g3 FROM (SELECT doc_id, {t.tok_a(d)} AS a FROM documents) x) y")
P("fingerprint", value=lambda d: t.fingerprint(d, "text"))
P("chunk_id", value=lambda d: f"substring(sha1(concat({d.string('doc_id')}, ':', '0', ':', substring({t.text(d)}, 1, 512))), 1, 20)")
P("document_id", value=lambda d: f"sha1(concat(coalesce(source, ''), substring({t.text(d)}, 1, 4096)))")
P("cache_key", value=lambda d: f"substring({d.sha256(f'concat(coalesce(source, {chr(39)}{chr(39)}), {chr(39)}:full{chr(39)})')}, 1, 16)")

# predicates
P("valid_pair", value=lambda d: f"(trim({t.text(d)}) <> '' AND {d.size(t.sentences_raw(d))} > 0)")
BOOK.sql("clean_record_filter", "documents", lambda d: f"""
WITH c AS (SELECT doc_id, text AS article, {d.get(t.sentences_raw(d), 1)} AS abstract FROM documents)
SELECT doc_id, {t.fingerprint(d, 'article')} AS fingerprint FROM c WHERE length(article) >= 100 AND length(abstract) >= 20 AND {d.size(t.tok_a(d, 'article'))} >= 30 AND {d.size(t.tok_a(d, 'abstract'))} >= 3""")
BOOK.sql("min_words_filter", "documents", lambda d: f"SELECT doc_id FROM documents WHERE {t.n_words(d)} >= 40 AND {t.n_words(d, d.get(t.sentences_raw(d), 1))} >= 8")
BOOK.sql("bench_sample_filter", "documents benchmark", lambda d: f"SELECT doc_id FROM documents x WHERE {t.n_words(d)} >= 30 AND NOT EXISTS (SELECT 1 FROM benchmark b WHERE trim(b.text) = trim(x.text))")
BOOK.sql("is_bad_generation", "documents", lambda d: f"""
WITH c AS (SELECT doc_id, {t.text(d)} AS s, {t.tok_a(d, t.clean(d, 'text'))} AS w FROM documents),
m AS (SELECT doc_id, max(n) AS top FROM (SELECT doc_id, v, count(*) AS n FROM (SELECT doc_id, {d.explode('w')} AS v FROM c) e GROUP BY doc_id, v) g GROUP BY doc_id)
SELECT /*+ MERGE(m) */ c.doc_id, (length(trim(s)) < 5 OR {d.size('w')} < 3 OR {d.size(d.rx_all('s', '[' + chr(92) + '[' + chr(92) + ']{}<>|' + chr(92) * 2 + ']'))} > greatest(2, length(s) * 0.03) OR {t.single_ratio(d, 'w')} > 0.35 OR ({d.size('w')} >= 8 AND {t.ratio(d, 'coalesce(top, 0)', d.size('w'))} > 0.35)
  OR {t.ratio(d, d.size(d.rx_all('s', '[^0-9A-Za-zÀ-ỹĐđ' + chr(92) + 's.,!?;:' + chr(39) + chr(34) + '()/%+' + chr(92) + '-]')), 'length(s)')} > 0.08) AS value FROM c LEFT JOIN m ON c.doc_id = m.doc_id""")
BAD_WITHOUT_TOP = f"""(length(trim(s)) < 5 OR size(w) < 3 OR {SPARK.size(SPARK.rx_all('s', '[' + chr(92) + '[' + chr(92) + ']{}<>|' + chr(92) * 2 + ']'))} > greatest(2, length(s) * 0.03) OR {t.single_ratio(SPARK, 'w')} > 0.35
  OR {t.ratio(SPARK, SPARK.size(SPARK.rx_all('s', '[^0-9A-Za-zÀ-ỹĐđ' + chr(92) + 's.,!?;:' + chr(39) + chr(34) + '()/%+' + chr(92) + '-]')), 'length(s)')} > 0.08)"""
#: How often the most frequent word of ``w`` occurs: the longest run of the sorted words.
TOP = "aggregate(sort_array(w), struct('' AS v, 0 AS n, 0 AS top), (a, y) -> struct(y AS v, if(y = a.v, a.n + 1, 1) AS n, greatest(a.top, if(y = a.v, a.n + 1, 1)) AS top), a -> a.top)"


def is_bad_generation(spark, sf_dir):
    """Texts cleaned once and counted where they are read; only the words of rows that repeat a doc_id are shuffled."""
    words = BOOK.statement("documents", f"SELECT doc_id, s, {t.tok_a(SPARK, 'c')} AS w FROM ({CLEANED}) x")(spark, sf_dir)
    rows = words.selectExpr("doc_id", f"{BAD_WITHOUT_TOP} AS bad", "size(w) AS n", f"if(doc_id IS NULL, 0, {TOP}) AS top")
    ids = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL")
    repeated = stored(ids.groupBy(F.col("doc_id").alias("of")).count().where("count > 1").select("of"), "repeated")
    if repeated.limit(1).count():
        counts = words.join(repeated, F.col("doc_id") == F.col("of"), "left_semi").select("doc_id", F.explode("w").alias("v")).groupBy("doc_id", "v").count()
        tops = counts.groupBy(F.col("doc_id").alias("of")).agg(F.max("count").cast("int").alias("most"))
        rows = rows.join(tops.hint("merge"), F.col("doc_id") == F.col("of"), "left").select("doc_id", "bad", "n", F.coalesce("most", "top").alias("top"))
    return rows.selectExpr("doc_id", f"(bad OR (n >= 8 AND {t.ratio(SPARK, 'top', 'n')} > 0.35)) AS value")


BOOK.queries["is_bad_generation"] = is_bad_generation
P("is_garbled_single", value=lambda d: t.garbled_single(d, "text"), ratio=lambda d: t.single_ratio(d, t.tok_a(d)))
BOOK.sql("is_editorial_sentence", "documents", lambda d: f"WITH s AS (SELECT doc_id, {d.explode(t.sentences_raw(d))} AS s FROM documents) SELECT doc_id, count(*) AS n, {d.count_if(t.editorial_line(d, 's'))} AS editorial FROM s GROUP BY doc_id")
P("foreign_script_ratio", value=lambda d: t.foreign_ratio(d, "concat(coalesce(text, ''), 'жяß')"))
P("vietnamese_ratio", value=lambda d: t.vietnamese_ratio(d, t.text(d)))
P("is_multilingual_garbage", value=lambda d: t.garbage(d, "text"), strict=lambda d: t.garbage(d, "text", True))
P("is_garbled_abstractive", value=lambda d: f"(length(trim({t.text(d)})) < 8 OR {t.garbage(d, 'text')} OR {t.garbled_single(d, 'text', 0.30)} OR ({t.n_words(d)} >= 6 AND ({d.size(d.filter(t.tok_e(d), d.rx_like('w', '^[A-Za-z]$'), 'w'))} >= 3 OR {t.ratio(d, d.size(d.filter(t.tok_e(d), 'length(w) <= 2', 'w')), t.n_words(d))} > 0.60 OR {d.size(d.filter(t.tok_e(d), d.rx_like('w', '[a-z]') + ' AND ' + d.rx_like('substring(w, 2)', '[A-Z]'), 'w'))} >= 4)))")
#: Foreign blocks by script name.
BLOCKS = (("Hangul", "[\\x{1100}-\\x{11FF}\\x{AC00}-\\x{D7AF}]"), ("Tamil", "[\\x{0B80}-\\x{0BFF}]"), ("Arabic", "[\\x{0600}-\\x{06FF}]"), ("Devanagari", "[\\x{0900}-\\x{097F}]"), ("Chinese/Japanese", "[\\x{4E00}-\\x{9FFF}\\x{3040}-\\x{30FF}]"), ("Cyrillic", "[\\x{0400}-\\x{04FF}]"), ("Greek", "[\\x{0370}-\\x{03FF}]"), ("Thai", "[\\x{0E00}-\\x{0E7F}]"))
P("detect_poor_training", scripts=lambda d: d.join(d.filter(d.array(*(f"CASE WHEN {d.rx_like(t.text(d), p)} THEN {d.lit(n)} END" for n, p in BLOCKS)), "x IS NOT NULL"), ", "), debris=lambda d: d.long(d.size(d.filter(t.tok_e(d), d.rx_like("w", "^[a-z]{3,}$") + " AND NOT " + d.rx_like("w", "[aeiouy]"), "w"))))
BOOK.sql("validate_output", "documents", lambda d: f"""
WITH s AS (SELECT doc_id, {t.text(d)} AS text FROM documents), w AS (SELECT doc_id, text, {t.tok_e(d)} AS words, {d.map(t.tok_e(d), 'lower(x)')} AS lw FROM s)
SELECT doc_id, CASE WHEN text = '' THEN 'empty' WHEN {t.garbage(d, 'text')} THEN 'multilingual' WHEN {d.rx_like('text', '▁|<extra_id_|</s>|<pad>|<unk>')} THEN 'artifact'
  WHEN {d.size(d.rx_all('text', '[+#_~*%^&|<>{}' + chr(92) + '[' + chr(92) + ']' + chr(92) * 2 + ']'))} > 3 THEN 'symbols' WHEN {d.rx_like('text', '[a-zA-ZÀ-ỹđĐ][+][a-zA-ZÀ-ỹđĐ]')} THEN 'joined'
  WHEN {d.size(d.rx_all('text', '[ẰẮẤẦẬẼỮỰẴ]'))} >= 2 THEN 'tonal' WHEN {t.word_loop(d, 'lw', 1)} THEN 'loop1' WHEN {t.word_loop(d, 'words', 2)} THEN 'loop2' WHEN {t.word_loop(d, 'words', 3)} THEN 'loop3' ELSE 'ok' END AS reason FROM w""")
P("is_admin_document", value=letters.is_letter)
P("low_value_noise", value=lambda d: f"(length(trim({t.text(d)})) <= 2 OR {d.rx_like(t.text(d), '^[-– 0-9/]+$')} OR ({t.n_words(d)} <= 2 AND NOT {d.rx_like(t.text(d), '[0-9]')}))")
BOOK.sql("quality_gate", "documents", lambda d: f"SELECT doc_id, CASE WHEN {t.n_words(d)} < 20 THEN 'fail' WHEN {t.garbled_single(d, 'text')} THEN 'warn' ELSE 'pass' END AS gate FROM documents")
BOOK.sql("looks_scanned", "documents", lambda d: f"SELECT source, {d.double('sum(n_chars)')} / count(*) AS chars_per_page, {d.double(f'sum({t.n_words(d)})')} / count(*) AS words_per_page, (sum(n_chars) / count(*) < 40 OR sum({t.n_words(d)}) / count(*) < 8) AS scanned FROM documents GROUP BY source")
P("estimate_language", value=lambda d: t.language(d, "text"))
P("is_comparison_query", "conversations", "conv_id, turn", value=lambda d: d.rx_like(f"lower({t.text(d)})", "so sánh|khác nhau|giống nhau|điểm chung|khác biệt|đối chiếu|compare|difference|versus"))
P("classify_intent", "conversations", "conv_id, turn", value=lambda d: f"CASE WHEN trim({t.text(d)}) = '' THEN 'GENERAL' WHEN {d.rx_like(f'lower({t.text(d)})', 'tóm tắt|summarize|tóm lược|khái quát')} THEN 'SUMMARIZE' WHEN {d.rx_like(f'lower(trim({t.text(d)}))', '^(chào|hello|hi|xin chào|cảm ơn|thanks?|tạm biệt|bye|goodbye|ok|okay)([^a-zà-ỹđ]|$)')} THEN 'GENERAL' ELSE 'DOCUMENT_QA' END")
BOOK.sql("time_range_filter", "events", lambda d: "SELECT event_id FROM events WHERE ts IS NULL OR ts >= TIMESTAMP '2024-01-24 00:00:00'")
BOOK.sql("document_filter", "documents", lambda d: "SELECT doc_id, n_chars FROM documents WHERE source IN ('src1', 'src3', 'src5')")
P("classify_line", "documents", "doc_id", value=lambda d: f"CASE WHEN {d.rx_like(t.text(d), '^[ ]*[-*•] ')} THEN 'bullet' WHEN length({t.text(d)}) < 90 AND {d.rx_like(t.text(d), '^[0-9]+([.][0-9]+)*[.]? ')} THEN 'heading' ELSE 'paragraph' END")
P("length_category", words=lambda d: f"CASE WHEN {t.n_words(d)} < 100 THEN 'Under' WHEN {t.n_words(d)} < 500 THEN 'Short' WHEN {t.n_words(d)} < 2000 THEN 'Medium' WHEN {t.n_words(d)} < 10000 THEN 'Long' ELSE 'Very Long' END", bench=lambda d: f"CASE WHEN {t.n_words(d)} < 250 THEN 'Short' WHEN {t.n_words(d)} < 500 THEN 'Medium' WHEN {t.n_words(d)} < 800 THEN 'Long' ELSE 'Very Long' END")

QUERIES, ORACLE = BOOK.queries, BOOK.oracle
