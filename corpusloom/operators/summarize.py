"""Extractive summaries: per-document algorithms in Arrow batches, one document at a time in memory."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import STOP_WORDS, WORD_A


def sentences(text: str | None) -> list[str]:
    """Split after . ! ? and at line feeds; repeated sentences (by their first 160 characters) are kept once."""
    found = [s.strip() for s in re.split(r"(?<=[.!?])\s+|\n+", text or "")]
    seen: dict[str, str] = {}
    for s in found:
        if s:
            seen.setdefault(" ".join(s.lower().split())[:160], s)
    return list(seen.values())


_STOPS = frozenset(STOP_WORDS)


@dataclass
class Rows:
    """A sparse matrix with L2-normalised rows: entries in order of their row, and the numbers of rows and columns."""

    row: np.ndarray
    col: np.ndarray
    val: np.ndarray
    n: int
    m: int

    def times(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.val * x[self.col], self.n)

    def transposed_times(self, y: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, self.val * y[self.row], self.m)

    def dense(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        stop = self.n if stop is None else stop
        a, b = np.searchsorted(self.row, (start, stop))
        out = np.zeros((stop - start, self.m))
        out[self.row[a:b] - start, self.col[a:b]] = self.val[a:b]
        return out


def matrix(sents: list[str]) -> Rows:
    """L2-normalised tf-idf rows; tf = count / words, idf = ln((1 + n) / (1 + df)) + 1."""
    found = (re.findall(WORD_A, s.lower()) if s.isascii() else [x.lower() for x in re.findall(WORD_A, s)] for s in sents)
    toks = [[w for w in x if len(w) > 1 and w not in _STOPS] for x in found]
    ids: dict[str, int] = {}
    flat = np.array([ids.setdefault(w, len(ids)) for t in toks for w in t], np.int64)
    size, many = np.array([len(t) for t in toks], np.int64), max(1, len(ids))
    key, first, count = np.unique(np.repeat(np.arange(len(toks)), size) * many + flat, return_index=True, return_counts=True)
    order = np.argsort(first)  # a row's words as they come first in it
    row, col = np.divmod(key[order], many)
    val = count[order] / size[row]
    val = val * (np.log((1 + len(sents)) / (1 + np.bincount(col, minlength=len(ids)))) + 1)[col] if len(val) else val
    norm = np.sqrt(np.bincount(row, val * val, len(sents)))
    return Rows(row, col, val / norm[row] if len(val) else val, len(sents), len(ids))


def iterate(n: int, step: Callable[[np.ndarray], np.ndarray], damping: float, rounds: int, tol: float) -> np.ndarray:
    r = np.full(n, 1 / n)
    for _ in range(rounds):
        new = (1 - damping) / n + damping * step(r)
        if np.abs(new - r).sum() < tol:
            return new
        r = new
    return r


def rank_nodes(w: np.ndarray, damping: float = 0.85, rounds: int = 100, tol: float = 1e-6) -> np.ndarray:
    """PageRank on a weighted graph; weight that leaves a node without edges is lost; no edges at all: uniform."""
    n = len(w)
    if not w.any():
        return np.full(n, 1 / max(1, n))
    out = w.sum(0)
    p = np.divide(w, out, out=np.zeros_like(w), where=out > 0)
    return iterate(n, lambda r: p @ r, damping, rounds, tol)


#: Rows of the similarity graph that are made at a time.
BLOCK = 512


def graph_rows(m: Rows):
    """(first row, rows) of the graph of sentence similarities, without loops; blocks of ``BLOCK`` rows, so that memory grows with the sentences and not their square."""
    other = m.dense().T if m.n * m.m <= 1 << 23 else None
    for a in range(0, m.n, BLOCK):
        b = min(m.n, a + BLOCK)
        part = m.dense(a, b)
        w = part @ other if other is not None else np.stack([m.times(x) for x in part])
        w[np.arange(b - a), np.arange(a, b)] = 0
        yield a, w


def textrank(m: Rows, damping: float = 0.85, rounds: int = 100, tol: float = 1e-6) -> np.ndarray:
    """PageRank over cosine similarities; the graph is never made: its product with a vector is that of two sparse matrices, less the loops."""
    loops = np.bincount(m.row, m.val * m.val, m.n)
    product = lambda x: m.times(m.transposed_times(x)) - loops * x
    out = product(np.ones(m.n))
    linked = out > 1e-12
    if not linked.any():
        return np.full(m.n, 1 / max(1, m.n))
    share = np.divide(1.0, out, out=np.zeros(m.n), where=linked)
    return iterate(m.n, lambda r: np.where(linked, product(share * r), 0.0), damping, rounds, tol)


def lexrank(m: Rows, damping: float = 0.85, rounds: int = 100, tol: float = 1e-6) -> np.ndarray:
    """PageRank over the similarities that reach the mean of the positive ones (0.1 if there are none); block by block."""
    small = [w for _, w in graph_rows(m)] if m.n <= 4 * BLOCK else None  # small enough to be kept
    total = count = 0.0
    for w in small if small is not None else (w for _, w in graph_rows(m)):
        total += w[w > 0].sum()
        count += (w > 0).sum()
    cut = total / count if count else 0.1
    kept = lambda w: np.where(w >= cut, w, 0)
    if small is not None:
        return rank_nodes(np.concatenate([kept(w) for w in small])) if m.n else np.zeros(0)
    out = np.concatenate([kept(w).sum(1) for _, w in graph_rows(m)])  # the graph is symmetric
    if not out.any():
        return np.full(m.n, 1 / m.n)
    share = np.divide(1.0, out, out=np.zeros(m.n), where=out > 0)
    return iterate(m.n, lambda r: np.concatenate([kept(w) @ (share * r) for _, w in graph_rows(m)]), damping, rounds, tol)


def tfidf(m: Rows) -> np.ndarray:
    return np.bincount(m.row, m.val, m.n)


def lsa(m: Rows, concepts: int = 3) -> np.ndarray:
    """Length of each sentence in the space of the first concepts; by subspace iteration where the sentences are many."""
    if not m.n or not m.m:
        return np.zeros(m.n)
    if m.n <= 4 * BLOCK:
        full = m.dense()
        squares, v = np.linalg.eigh(full @ full.T)  # of the sentences' products: as the singular values and vectors, for less
        top = np.argsort(-squares)[:concepts]
        return np.sqrt((np.maximum(squares[top], 0) * v[:, top] ** 2).sum(1))
    q = np.linalg.qr(np.random.default_rng(0).normal(size=(m.n, concepts + 12)))[0]
    for _ in range(60):
        q = np.linalg.qr(np.stack([m.times(m.transposed_times(x)) for x in q.T], 1))[0]
    _, s, v = np.linalg.svd(np.stack([m.transposed_times(x) for x in q.T], 1), full_matrices=False)
    left = q @ v.T
    k = min(concepts, int((s > 1e-10).sum()))
    return np.sqrt(((left[:, :k] * s[:k]) ** 2).sum(1))


RUNNERS: dict[str, Callable] = {"textrank": textrank, "lexrank": lexrank, "tfidf": tfidf, "lsa": lsa}


def select(scores: np.ndarray, k: int) -> list[int]:
    """Greedy picks; after the first, neighbours of picks gain 0.12 and those two away 0.06; ties to the lower index; in text order."""
    if len(scores) <= k:
        return list(range(len(scores)))
    left, picks = np.array(scores, float), []
    gap = np.full(len(left), 9)
    at = np.arange(len(left))
    while len(picks) < k:
        total = left + np.where(gap == 1, 0.12, np.where(gap == 2, 0.06, 0.0))
        total[picks] = -np.inf
        picks.append(int(np.argmax(total)))
        gap = np.minimum(gap, np.abs(at - picks[-1]))
    return sorted(picks)


def summarize(docs: DataFrame, algorithm: str = "textrank", k: int = 3, text_col: str = "text") -> DataFrame:
    """``docs`` with n_sentences, picks (indices) and summary; every sentence of the text is scored."""
    run = RUNNERS[algorithm]

    def one(text):
        s = sentences(text)
        picks = select(run(matrix(s)), k) if len(s) > k else list(range(len(s)))
        return len(s), picks, " ".join(s[i] for i in picks)

    kind = "struct<n_sentences: int, picks: array<int>, summary: string>"
    udf = F.pandas_udf(lambda c: pd.DataFrame([one(x) for x in c], columns=["n_sentences", "picks", "summary"]), kind)
    return docs.withColumn("result", udf(F.col(text_col))).select(*[c for c in docs.columns if c != text_col], "result.*")


def summaries(docs: DataFrame, algorithms: tuple[str, ...], k: int = 3, text_col: str = "text") -> DataFrame:
    """``summarize`` by each of ``algorithms``, which the last column names; a text is read, parted and weighed once for all of them."""

    def one(text):
        s = sentences(text)
        m = matrix(s) if len(s) > k else None
        picks = [select(RUNNERS[a](m), k) if m else list(range(len(s))) for a in algorithms]
        return [{"n_sentences": len(s), "picks": p, "summary": " ".join(s[i] for i in p), "algorithm": a} for a, p in zip(algorithms, picks)]

    udf = F.pandas_udf(lambda c: c.map(one), "array<struct<n_sentences: int, picks: array<int>, summary: string, algorithm: string>>")
    kept = [c for c in docs.columns if c != text_col]
    return docs.select(*kept, F.explode(udf(F.col(text_col))).alias("result")).select(*kept, "result.*")


def score_table(docs: DataFrame, algorithm: str = "textrank", k: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, i, score, selected) of every sentence."""
    run = RUNNERS[algorithm]

    def one(text):
        s = sentences(text)
        z = run(matrix(s)) if s else []
        chosen = set(select(np.asarray(z), k)) if len(s) else set()
        return [{"i": i, "score": float(x), "selected": i in chosen} for i, x in enumerate(z)]

    udf = F.pandas_udf(lambda c: c.map(one), "array<struct<i: int, score: double, selected: boolean>>")
    return docs.select(id_col, F.explode(udf(F.col(text_col))).alias("x")).select(id_col, "x.*")


def hybrid_condense(docs: DataFrame) -> DataFrame:
    """Extractive stage of a hybrid: keep max(3, min(0.35 n, 25)) sentences."""

    def one(text):
        s = sentences(text)
        n = max(3, min(int(len(s) * 0.35), 25))
        return " ".join(s[i] for i in (select(textrank(matrix(s)), n) if len(s) > n else range(len(s))))

    return docs.select("doc_id", F.pandas_udf(lambda c: c.map(one), "string")("text").alias("condensed"))


def map_reduce_summary(docs: DataFrame, words: int = 300, per_chunk: int = 2, final: int = 6, most_chunks: int = 48) -> DataFrame:
    """Chunks of about ``words`` words, two sentences each, then six of those."""

    def one(text):
        chunks, size = [[]], 0
        for s in sentences(text):
            n = len(s.split())
            if chunks[-1] and size + n > words:
                chunks.append([])
                size = 0
            chunks[-1].append(s)
            size += n
        kept = [c[i] for c in chunks[:most_chunks] if sum(len(s.split()) for s in c) >= 12 for i in select(textrank(matrix(c)), per_chunk)]
        return " ".join(kept[i] for i in select(textrank(matrix(kept)), final)) if kept else ""

    return docs.select("doc_id", F.pandas_udf(lambda c: c.map(one), "string")("text").alias("summary"))
