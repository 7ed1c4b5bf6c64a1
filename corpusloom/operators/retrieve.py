"""Hybrid retrieval with vectors, and the comparison of embedding models."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from corpusloom.functions.arrow import embed, embed_all, hashed_vectors, word_hashes
from corpusloom.operators.chunk import CHUNKERS
from corpusloom.session import stored

#: Fusion constants, weights, sizes and thresholds of the retriever.
RRF_K, DENSE_W, BM25_W, POOL, RELAXED = 60, 0.7, 0.3, 8, 0.15


def fusion_depth(pool: int = POOL) -> int:
    """Dense rank beyond which nothing is among the ``pool`` best fused scores, even as the best by BM25: the first ``pool`` by vector all score more."""
    n = pool
    while DENSE_W / (RRF_K + n + 1) + BM25_W / (RRF_K + 1) >= DENSE_W / (RRF_K + pool):
        n += 1
    return n


def _best(scores: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Places of the n highest scores, ties to smaller ids."""
    if len(scores) > n:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - n)[len(scores) - n])
    else:
        at = np.arange(len(scores))
    order = np.unique(ids[at], return_inverse=True)[1]
    return at[np.lexsort((order, -scores[at]))[:n]]


def dense_top(chunks: DataFrame, queries: DataFrame, n: int, dim: int = 256, block: int = 4096) -> DataFrame:
    """(qid, doc_id, sim, rd): for each of ``queries`` (qid, query) the n rows of ``chunks`` (doc_id, text) nearest by cosine, ties to smaller ids.

    The query set goes in blocks of about ``block`` (a block's vectors are ``block * dim`` floats)
    against all rows: each task keeps n rows a query, so what is shuffled grows with tasks and queries, not with pairs.
    Null texts count as empty (similarity 0); null ids take no part.
    """
    blocks = max(1, -(-queries.count() // block))
    ids, kinds = dict(chunks.dtypes)["doc_id"], dict(queries.dtypes)["qid"]
    types = [to_arrow_type(queries.schema["qid"].dataType), to_arrow_type(chunks.schema["doc_id"].dataType)]
    found = None
    for k in range(blocks):
        part = queries.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == k).select("qid", "query").collect()
        if part:
            names, q = [r.qid for r in part], np.stack([embed(r.query or "", dim) for r in part]).astype(float)

            def run(batches: Iterator[pa.RecordBatch], names: list = names, q: np.ndarray = q) -> Iterator[pa.RecordBatch]:
                held = [(np.zeros(0), np.zeros(0, object)) for _ in names]
                for b in batches:
                    who = np.array(b.column(0).to_pylist(), object)
                    if len(who):
                        sims = np.round(q @ embed_all([t or "" for t in b.column(1).to_pylist()], dim).astype(float).T, 9)
                        for i, (s, w) in enumerate(held):
                            s, w = np.concatenate([s, sims[i]]), np.concatenate([w, who])
                            at = _best(s, w, n)
                            held[i] = s[at], w[at]
                for i, (s, w) in enumerate(held):
                    if len(s):
                        yield pa.RecordBatch.from_arrays([pa.array([names[i]] * len(s), types[0]), pa.array(w.tolist(), types[1]), pa.array(s)], names=["qid", "doc_id", "sim"])

            got = chunks.select("doc_id", "text").where("doc_id IS NOT NULL").mapInArrow(run, f"qid {kinds}, doc_id {ids}, sim double")
            found = got if found is None else found.unionByName(got)
    if found is None:
        found = queries.limit(0).crossJoin(chunks.limit(0)).select("qid", "doc_id", F.lit(0.0).alias("sim"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("sim"), "doc_id"))
    return found.withColumn("rd", rank).where(F.col("rd") <= n)


#: Ranks by BM25 (qid, doc_id, rb) of the chunks that share a word with the query; or what gives, for some (qid, doc_id), these ranks of theirs and how many chunks have ranks (qid, last).
Lexical = DataFrame | Callable[[DataFrame], tuple[DataFrame, DataFrame]]


def pooled(chunks: DataFrame, queries: DataFrame, lexical: Lexical, dim: int = 256) -> DataFrame:
    """(qid, doc_id, sim, combined, pos): the ``POOL`` best of each query by vector and BM25 ranks, fused; see ``hybrid``."""
    near = dense_top(chunks, queries, fusion_depth(), dim)
    if isinstance(lexical, DataFrame):
        last = lexical.groupBy("qid").agg(F.max("rb").alias("last"))
    else:
        near = stored(near, "near")
        lexical, last = lexical(near)
    last = last.select(F.col("qid").alias("q"), "last")
    ranks = lexical.select(F.col("qid").alias("lq"), F.col("doc_id").alias("ld"), "rb")
    both = near.join(ranks, (F.col("qid") == F.col("lq")) & (F.col("doc_id") == F.col("ld")), "left").join(last, F.col("qid") == F.col("q"), "left")
    rb = F.coalesce("rb", F.col("last") + 1, F.lit(1))
    fused = both.select("qid", "doc_id", "sim", F.round(100 * (DENSE_W / (RRF_K + F.col("rd")) + BM25_W / (RRF_K + rb)), 9).alias("combined"))
    return fused.withColumn("pos", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("combined"), "doc_id"))).where(F.col("pos") <= POOL)


def picked(pool: DataFrame, chunks: DataFrame, top: int = 5, threshold: float = 0.175, each_source: int = 2) -> DataFrame:
    """What ``hybrid`` returns, of the ``pool`` that ``pooled`` gives."""
    by = Window.partitionBy("qid")
    pool = pool.withColumn("rerank", F.round(0.6 * F.col("combined") + 0.4 * F.col("sim"), 9)).withColumn("good", F.col("rerank") >= threshold)
    some = pool.withColumn("any", F.max("good").over(by)).where(F.col("good") | (~F.col("any") & (F.col("pos") <= 3) & (F.col("rerank") >= RELAXED)))
    ordered = some.withColumn("nth", F.row_number().over(by.orderBy(F.desc("rerank"), "doc_id"))).where(F.col("any") | (F.col("nth") == 1))
    placed = ordered.join(chunks.select(F.col("doc_id").alias("d"), "source"), F.col("doc_id") == F.col("d"))
    spread = placed.withColumn("dup", F.row_number().over(Window.partitionBy("qid", "source").orderBy("nth"))).where(F.col("dup") <= each_source)
    return spread.withColumn("rank", F.row_number().over(by.orderBy("nth"))).where(F.col("rank") <= top).select("qid", "doc_id", "source", F.col("sim").alias("embedding_score"), "combined", "rerank", "rank")


def hybrid(chunks: DataFrame, queries: DataFrame, lexical: Lexical, top: int = 5, threshold: float = 0.175, each_source: int = 2, dim: int = 256) -> DataFrame:
    """(qid, doc_id, source, embedding_score, combined, rerank, rank): vector and BM25 ranks fused, reranked, held to a threshold, spread over sources.

    chunks: (doc_id, source, text); queries: (qid, query); chunks without a rank by BM25 come after those that have one.
    Only the first ``fusion_depth()`` by vector can reach the pool, so no more are fused. Where nothing reaches the threshold,
    the best of the first three does if it reaches ``RELAXED``. Ties go to smaller ids.
    """
    return picked(pooled(chunks, queries, lexical, dim), chunks, top, threshold, each_source)


#: How much lower the threshold and how many more chunks each further try takes, its least threshold, the tries after the first, and the characters that a context must pass.
STEP, MORE, LOWEST, RETRIES, LEAST_CONTEXT = 0.08, 2, 0.1, 2, 80


def with_retries(search: Callable[[DataFrame, int, float], DataFrame], queries: DataFrame, texts: DataFrame, top: int = 5, threshold: float = 0.25, enough: Callable[[], Column] | None = None) -> DataFrame:
    """(qid, tries, threshold, top, doc_id, rerank, rank): what each query found in its last try; doc_id is null where that is nothing.

    ``search(queries, top, threshold)`` gives (qid, doc_id, rerank, rank); ``texts`` (doc_id, text). A query whose context is
    not ``enough`` (an aggregate over its rows with ``text``; by default more than ``LEAST_CONTEXT`` characters in all) is
    searched again, with a lower threshold and more chunks, at most ``RETRIES`` times. Each try sees only the queries that
    are left, and is written, so that the next does not compute it again.
    """
    enough = enough or (lambda: F.sum(F.coalesce(F.length("text"), F.lit(0))) > LEAST_CONTEXT)
    left, done = queries, []
    for tries in range(RETRIES + 1):
        k, least = top + MORE * tries, max(LOWEST, threshold - STEP * tries)
        found = search(left, k, least).select("qid", "doc_id", "rerank", "rank")
        held = texts.select(F.col("doc_id").alias("d"), "text")
        context = found.join(held, F.col("doc_id") == F.col("d"), "left").groupBy(F.col("qid").alias("q")).agg(F.coalesce(enough(), F.lit(False)).alias("enough"))
        rows = left.select("qid").join(context, F.col("qid") == F.col("q"), "left").select(F.col("qid").alias("own"), F.coalesce("enough", F.lit(False)).alias("enough"))
        tried = stored(rows.join(found, F.col("own") == F.col("qid"), "left").select(F.col("own").alias("qid"), "enough", F.lit(tries).alias("tries"), F.lit(float(least)).alias("threshold"), F.lit(k).alias("top"), "doc_id", "rerank", "rank"), "tries")
        last = tries == RETRIES
        done.append((tried if last else tried.where("enough")).drop("enough"))
        if last:
            break
        open_ = tried.where(~F.col("enough")).select(F.col("qid").alias("q")).distinct()
        left = stored(left.join(open_, F.col("qid") == F.col("q"), "left_semi"), "open")
        if not left.limit(1).count():
            break
    return reduce(DataFrame.unionByName, done)


def words(text: str) -> set[str]:
    return set(re.findall(r"\w+", text.lower()))


def benchmark_text(texts: list[str], query: str, dim: int, k: int = 5) -> tuple[int, float, int, float, float, float] | None:
    """(adjacent pairs, their summed cosine, 1 if there are relevant chunks, hit at k, reciprocal rank, share of the query's words in the k nearest); relevant are up to three chunks that hold the most of the query's words."""
    found = benchmark_dims(texts, query, (dim,), k)
    return found[0] if found else None


def benchmark_dims(texts: list[str], query: str, dims: tuple[int, ...], k: int = 5) -> list[tuple[int, float, int, float, float, float]]:
    """``benchmark_text`` for each of ``dims``: words are parted and hashed once for all of them."""
    if not texts:
        return []
    want = words(query)
    shared = [want & words(t) for t in texts]
    share = np.array([len(x) / max(1, len(want)) for x in shared])
    relevant = {i for i in np.argsort(-share, kind="stable")[:3].tolist() if share[i] > 0}
    hashes, size = word_hashes([*texts, query])
    out = []
    for dim in dims:
        *v, q = hashed_vectors(hashes, size, dim).astype(float)
        v = np.stack(v)
        order = np.argsort(-np.round(v @ q, 9), kind="stable").tolist()
        first = next((r for r, i in enumerate(order, 1) if i in relevant), 0)
        held = set().union(*(shared[i] for i in order[:k]))
        out.append((len(v) - 1, float((v[:-1] * v[1:]).sum()), int(bool(relevant)), float(0 < first <= k), 1 / first if first else 0.0, len(held) / max(1, len(want))))
    return out


def embedding_benchmark(docs: DataFrame, dims: tuple[int, ...] = (32, 64, 256), text_col: str = "text") -> DataFrame:
    """(model, dimension, documents, chunks, coherence, hit_at_5, mrr, coverage) of hashing embeddings of each dimension.

    A document's query is its first sentence. Sums leave each Arrow batch, not chunks; times are not
    measured. Documents without chunks take no part.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            rows = []
            for text in p["t"].fillna(""):
                texts = [c["text"] if isinstance(c, dict) else c[1] for c in CHUNKERS["token"](text)]
                query = re.split(r"(?<=[.!?])\s+", text.strip())[0]
                rows += [(dim, 1, len(texts), *got) for dim, got in zip(dims, benchmark_dims(texts, query, dims))]
            yield pd.DataFrame(rows, columns=["dimension", "n", "chunks", "pairs", "cosine", "asked", "hit", "rr", "cov"]).groupby("dimension", as_index=False).sum()

    sums = docs.select(F.col(text_col).cast("string").alias("t")).mapInPandas(run, "dimension int, n long, chunks long, pairs long, cosine double, asked long, hit double, rr double, cov double")
    of = lambda x, n: F.round(F.sum(x) / F.greatest(F.sum(n), F.lit(1)), 6)
    out = sums.groupBy("dimension").agg(F.sum("n").alias("documents"), F.sum("chunks").alias("chunks"), of("cosine", "pairs").alias("coherence"), of("hit", "asked").alias("hit_at_5"), of("rr", "asked").alias("mrr"), of("cov", "n").alias("coverage"))
    return out.select(F.concat(F.lit("hash-"), F.col("dimension").cast("string")).alias("model"), *out.columns)
