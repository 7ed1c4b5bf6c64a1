"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the average of the embeddings of its character n-grams and beginnings (hashed), a window of ``WINDOW``
words the average of its words, and two linear outputs with softmax give the window's probability;
the document takes its most toxic window, so that a few words in a long text are not averaged
away. Misspelt or inflected words that training never saw share n-grams with those it saw.

Training uses the labelled rows only, at most ``most_each`` documents of each class (those with
the smallest digest of their id): the documented bound of what reaches the driver. The gradient
goes through each document's most toxic window, after some steps over all its windows. Scoring
runs over whole texts in Arrow batches; the model that is sent out has ``BUCKETS`` numbers.

Defined results: null and empty texts score as a window without words does (the bias alone).
Rows that repeat each return a row; a null id counts as the empty text for the hold-out rule and
is never learnt from; a null label is no label. Without labels of both classes every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import raw_texts

BITS = 17
BUCKETS = 1 << BITS
WINDOW = 32
LEAST = 8
DIMS = 8
#: Share of the loss that the toxic documents have.
PRIOR = 0.5
#: A word's beginnings of so many bytes, its border included, count ``STEM`` times each: inflected and misspelt words share them.
STEMS, STEM = range(5, 11), 3
CACHED = 400_000
#: ASCII control characters, punctuation and white space part words.
PARTS = bytes(32 if i < 128 and not chr(i).isalnum() else i for i in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.decode("utf-8", "replace").lower().encode().translate(PARTS).split()


def _bucket(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def gram_buckets(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(word index, bucket) of every 3- to 5-byte n-gram of the words, with word borders, and of their beginnings."""
    held = np.frombuffer(b"".join(b"<" + w + b">" for w in words), np.uint8).astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    of = np.repeat(np.arange(len(words)), size)
    end = np.repeat(np.cumsum(size), size)
    who, bucket = [], []
    for n in (3, 4, 5):
        at = np.flatnonzero(np.arange(len(held)) + n <= end)
        h = np.full(len(at), n, np.uint64)
        for i in range(n):
            h = h * np.uint64(0x100000001B3) + held[at + i] + np.uint64(1)
        who.append(of[at])
        bucket.append(_bucket(h))
    first = np.cumsum(size) - size
    h = np.full(len(words), 2, np.uint64)
    for n in range(1, STEMS.stop):
        at = np.flatnonzero(size >= n)
        h[at] = h[at] * np.uint64(0x100000001B3) + held[first[at] + n - 1] + np.uint64(1)
        if n in STEMS:
            who.append(np.repeat(at, STEM))
            bucket.append(np.repeat(_bucket(h[at]), STEM))
    return np.concatenate(who), np.concatenate(bucket)


def window_starts(n: int) -> np.ndarray:
    """Starts of consecutive windows; a short rest joins the window before it."""
    s = np.arange(0, max(n, 1), WINDOW)
    return s[:-1] if len(s) > 1 and n - s[-1] < WINDOW // 2 else s


@dataclass
class Model:
    weight: np.ndarray  # of each bucket: its embedding times the difference of the two outputs
    bias: float


def fit(texts: list[bytes], labels: list[int], steps: int = 160, all_steps: int = 80, rate: float = 0.05, decay: float = 1e-5, seed: int = 7) -> Model:
    """Joint full-batch training (Adam) of the embeddings and the linear outputs."""
    y = np.array(labels, np.float64)
    if len(set(labels)) < 2:
        return Model(np.zeros(BUCKETS, np.float32), -40.0)
    ids: dict[bytes, int] = {}
    tokens, starts, owner = [], [], []
    base = 0
    for d, t in enumerate(texts):
        ws = words_of(t)
        if not ws:
            continue
        s = window_starts(len(ws))
        tokens.append(np.array([ids.setdefault(w, len(ids)) for w in ws]))
        starts.append(s + base)
        owner.append(np.full(len(s), d))
        base += len(ws)
    tokens, starts, owner = np.concatenate(tokens), np.concatenate(starts), np.concatenate(owner)
    span = np.diff(np.append(starts, len(tokens)))
    size = np.maximum(span, LEAST)
    pairs = np.unique(np.repeat(np.arange(len(starts)), span) * len(ids) + tokens)  # a word counts once in a window
    window_of, tokens = np.divmod(pairs, len(ids))
    starts = np.searchsorted(window_of, np.arange(len(starts)))
    g_who, g_flat = gram_buckets(list(ids))
    g_n = np.bincount(g_who, minlength=len(ids))
    doc_start = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    docs = owner[doc_start]
    n_win = np.diff(np.append(doc_start, len(owner)))
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (BUCKETS, DIMS))
    out = rng.normal(0, 0.1, (DIMS, 2))
    bias = np.zeros(2)
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (emb, out, bias)]
    balance = np.where(y == 1, PRIOR / y.mean(), (1 - PRIOR) / (1 - y.mean()))
    for step in range(1, steps + 1):
        axis = out[:, 1] - out[:, 0]
        by_bucket = emb @ axis
        by_word = np.bincount(g_who, by_bucket[g_flat], len(ids)) / g_n
        logit = np.add.reduceat(by_word[tokens], starts) / size + bias[1] - bias[0]
        top = np.maximum.reduceat(logit, doc_start)
        if step <= all_steps:
            share = np.repeat(1.0 / n_win, n_win)
        else:
            share = (logit == np.repeat(top, n_win)).astype(float)
            share /= np.repeat(np.add.reduceat(share, doc_start), n_win)
        p = 1 / (1 + np.exp(-np.clip(logit, -40, 40)))
        d_logit = share * (p - np.repeat(y[docs], n_win)) * np.repeat(balance[docs], n_win) / len(docs)
        d_word = np.bincount(tokens, (d_logit / size)[window_of], len(ids))
        d_bucket = np.bincount(g_flat, (d_word / g_n)[g_who], BUCKETS)
        d_axis = emb.T @ d_bucket
        grads = (np.outer(d_bucket, axis) + decay * emb, np.stack([-d_axis, d_axis], 1), np.array([-d_logit.sum(), d_logit.sum()]))
        for x, dx, (m, v) in zip((emb, out, bias), grads, state):
            m += 0.1 * (dx - m)
            v += 0.01 * (dx * dx - v)
            x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model((emb @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


class Scorer:
    """Scores of texts, with the words' values kept (at most about ``CACHED``)."""

    def __init__(self, model: Model):
        self.model, self.words = model, {}

    def __call__(self, texts: list[bytes]) -> list[float]:
        split = [words_of(t) for t in texts]
        new = list(set().union(*split) - self.words.keys())
        if len(self.words) + len(new) > CACHED:
            self.words.clear()
            new = list(set().union(*split))
        if new:
            who, bucket = gram_buckets(new)
            self.words.update(zip(new, (np.bincount(who, self.model.weight[bucket], len(new)) / np.bincount(who, minlength=len(new))).tolist()))
        get, out = self.words.__getitem__, []
        for ws in split:
            s = [*window_starts(len(ws)).tolist(), len(ws)]
            x = max(sum(map(get, set(ws[a:b]))) / max(b - a, LEAST) for a, b in zip(s, s[1:])) if ws else 0.0
            out.append(float(1 / (1 + np.exp(-np.clip(x + self.model.bias, -40, 40)))))
        return out


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, most_each: int = 1500) -> Model:
    """Fit on at most ``most_each`` labelled documents of each class that are not held out."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = [known.where(F.col("toxic") == c).orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(most_each) for c in (0, 1)]
    picked = some[0].union(some[1])  # at most 2 * most_each rows of two numbers
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: r.doc_id)
    return fit([(r.text or "").encode() for r in rows], [r.toxic for r in rows])


def score(docs: DataFrame, model: Model, cut: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in batches:
            s = []
            for i in range(0, b.num_rows, 256):
                s += scorer(list(raw_texts(b.column(2).slice(i, 256))))
            yield pa.record_batch([b.column(0), b.column(1), pa.array(s, pa.float64()), pa.array([int(x >= cut) for x in s], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    d = docs.select("doc_id", held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")
