"""The queries of this subpackage and, where SQL can express them, their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm import changepoints, decontam, filteraudit, licenses, linededup, lmscore, mixing, quality, simhash, tokencount, topk, toxicity, warc
from corpusloom.session import table


def op1_simhash(spark, sf_dir):
    """SimHash classes of every document; texts without words have fingerprint zero. Null ids take part and order last."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op2_licenses(spark, sf_dir):
    """Licence of each whole text (null: none) and the names of its one-line notices."""
    known = licenses.catalogue(spark)
    return licenses.scan(table(spark, sf_dir, "documents"), known, known).withColumn("notices", F.array_join("notices", ","))


def op3_quality(spark, sf_dir):
    """Perplexity, its language's threshold and the verdict of each document; null and empty texts are rejected."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    out, names = quality.classify(docs, quality.trusted_ids(table(spark, sf_dir, "labels")))
    return out.select("doc_id", "lang", *names)


def op4_toxicity(spark, sf_dir):
    """Toxicity score of each document; learnt without the rows that are held out."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op5_decontam(spark, sf_dir):
    """Pairs of a document and a benchmark item that it holds."""
    return decontam.contaminated(table(spark, sf_dir, "documents"), decontam.split_items(table(spark, sf_dir, "benchmark")))


def op6_linededup(spark, sf_dir):
    """Numbers of lines and of kept lines of each document, and digest and length of what is left; null texts: 0, 0, null, null."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.dedup_lines(docs, counts=("n_lines", "n_kept")).select("doc_id", "n_lines", "n_kept", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


def op7_warc(spark, sf_dir):
    """Each record with the full response that it stands for, if any, and the merged headers."""
    out = warc.resolve(warc.records_of_pages(table(spark, sf_dir, "pages")))
    headers = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return out.select("record_id", "url_key", "full_id", "state", headers.alias("headers"), F.length("payload").cast("long").alias("payload_chars"), F.md5("payload").alias("payload_md5"))


def op8_tokencounts(spark, sf_dir):
    """UTF-8 bytes and tokens of each document; null texts count as empty."""
    import public_tokenizers

    return tokencount.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_mixing(spark, sf_dir):
    """Words that the mix takes of each document."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_topk(spark, sf_dir):
    """Twenty best inner products of each vector whose id is divisible by 20; invalid vectors take no part."""
    v = topk.placed(topk.quantized(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"))
    return topk.top_k(v, v.where(F.col("id") % 20 == 0), k=20)


def op11_changepoints(spark, sf_dir):
    """Segments of each vendor's daily quantity."""
    return changepoints.vendor_segments(table(spark, sf_dir, "sale_lines"))


def op12_filteraudit(spark, sf_dir):
    """What each of five filters removes in every order, per source."""
    return filteraudit.audit_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_lmscore(spark, sf_dir):
    """Unigram base and marginal lattice probability of each document; learnt without the rows that are held out."""
    import public_tokenizers

    return lmscore.score(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


OP10_SQL = """
WITH v AS (SELECT vec_id, row_number() OVER () AS row_, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.row_, q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.row_ <> c.row_),
r AS (SELECT *, row_number() OVER (PARTITION BY row_ ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

QUERIES = {"pipeline": corpus_pipeline.run, "op1_simhash": op1_simhash, "op2_licenses": op2_licenses, "op3_quality": op3_quality, "op4_toxicity": op4_toxicity, "op5_decontam": op5_decontam, "op6_linededup": op6_linededup, "op7_warc": op7_warc, "op8_tokencounts": op8_tokencounts, "op9_mixing": op9_mixing, "op10_topk": op10_topk, "op11_changepoints": op11_changepoints, "op12_filteraudit": op12_filteraudit, "op13_lmscore": op13_lmscore}
OP7_SQL = """
WITH p AS (SELECT page_id, url, html, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '/+$', '') AS x FROM pages),
c AS (SELECT *, lower(regexp_extract(x, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS head, lower(regexp_replace(regexp_extract(x, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)', 1), '^.*@', '')) AS host,
  regexp_replace(regexp_extract(x, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)', 1), '/+$', '') AS path,
  array_to_string(list_sort(list_filter(string_split(regexp_extract(x, '\\?(.*)$', 1), '&'), lambda q: q <> '' AND NOT regexp_matches(lower(q), '^(utm_[a-z]+|gclid|fbclid|phpsessid|jsessionid|sid)='))), '&') AS q FROM p),
u AS (SELECT page_id, html, '"' || md5(html) || '"' AS tag, head || '://' || regexp_replace(host, CASE head WHEN 'http' THEN ':80$' ELSE ':443$' END, '') || path || CASE WHEN q = '' THEN '' ELSE '?' || q END AS url_key FROM c),
r AS (SELECT page_id * 2 AS record_id, url_key, page_id AS date, true AS response, page_id % 11 <> 0 AS is_full, tag AS etag, 'day ' || (page_id % 28) AS lm, page_id, html FROM u
  UNION ALL SELECT page_id * 2 + 1, url_key, page_id + page_id % 97, false, false, CASE WHEN page_id % 5 = 0 THEN '"other"' WHEN page_id % 7 <> 0 THEN tag END, CASE WHEN page_id % 3 <> 0 THEN 'day ' || (page_id % 28) END, page_id, NULL FROM u),
a AS (SELECT *, last_value(CASE WHEN is_full THEN record_id END IGNORE NULLS) OVER (PARTITION BY url_key ORDER BY date, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM r),
j AS (SELECT a.*, CASE WHEN NOT a.response THEN a.prior END AS full_id, f.etag AS fe, f.lm AS fl, f.page_id AS fp, f.html AS fh FROM a LEFT JOIN r f ON NOT a.response AND a.prior = f.record_id),
s AS (SELECT *, CASE WHEN response THEN CASE WHEN is_full THEN 'full' ELSE 'other' END WHEN full_id IS NULL THEN 'unresolved' WHEN etag IS NOT NULL THEN CASE WHEN etag = fe THEN 'verified' ELSE 'mismatch' END
  WHEN lm IS NOT NULL THEN CASE WHEN lm = fl THEN 'verified' ELSE 'mismatch' END ELSE 'unverified' END AS state FROM j),
b AS (SELECT *, CASE WHEN response THEN html WHEN state IN ('verified', 'unverified') THEN fh END AS body FROM s)
SELECT record_id, url_key, full_id, state, CASE WHEN response THEN 'age=0;content-type=text/html;x-page=' || page_id WHEN state IN ('verified', 'unverified') THEN 'age=' || (page_id % 97) || ';content-type=text/html;x-page=' || fp
  ELSE 'age=' || (page_id % 97) || ';content-type=none' END AS headers, length(body) AS payload_chars, md5(body) AS payload_md5 FROM b
"""

ORACLE = {"op2_licenses": licenses.oracle(), "op7_warc": OP7_SQL, "op9_mixing": mixing.ORACLE, "op10_topk": OP10_SQL, "op11_changepoints": changepoints.ORACLE, "op12_filteraudit": filteraudit.ORACLE}


def queries():
    return dict(QUERIES)


def oracle_sql():
    return ORACLE | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
