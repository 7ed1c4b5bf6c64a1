"""Benchmark decontamination: a BM25 index of test items, searched by block-max WAND.

The items are the indexed documents; every passage of a training text is a query over its distinct
words. An item's threshold is what BM25 gives at least to a passage that holds ``overlap`` of the
item's five-word shingles: then at most as many of its words are missing as shingles are, so the
threshold is the item's own score less its heaviest terms of that number. Weights are divided by
their item's threshold, so that one bound, 1, serves all items, and every item that reaches it is
retrieved - nothing is cut to a top k. Retrieved pairs are verified by exact shingle overlap:
``overlap`` of question and answer together, and ``each`` of the question and of the answer (if the
item has one), so that neither half alone makes a leak. Passages are twice the longest item's words and start every half, so that
each stretch as long as an item lies whole in one.

A passage whose summed term maxima stay below 1 is dropped before the search (vectorised). The
search sums the terms' maxima over blocks of ``BLOCK`` items, passes over blocks below 1, and moves
through the others item by item with the usual pivot.

Scale: texts stay where they are read. The index is broadcast in shards of at most
``items_per_shard`` items (a proven bound), one pass over the texts for each shard; shards are
collected, built, searched and released one after the other, so the driver holds one at a time.

Defined results: null or empty texts and items match nothing. Words are runs of anything but ASCII
white space and punctuation, lower-cased. Items under five words count as one shingle. Item ids may be of any type; items with a null id are left out. Repeated
items are one each; repeated rows of a text each return their pairs; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.sql.pandas.types import to_arrow_type

from corpusloom.llm.common import Scratch, raw_texts

K1, B = 1.2, 0.75
BLOCK = 4
SHINGLE = 5
PARTS = bytes(32 if i < 128 and not chr(i).isalnum() else i for i in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.decode("utf-8", "replace").lower().encode().translate(PARTS).split()


def shingles(words: list, n: int = SHINGLE) -> set[tuple]:
    """Distinct shingles; shorter sequences are one, none have none."""
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


@dataclass
class Item:
    item_id: int
    question: list[bytes]
    answer: list[bytes]
    q: set = field(default_factory=set)
    a: set = field(default_factory=set)
    every: set = field(default_factory=set)

    def __post_init__(self) -> None:
        self.q, self.a, self.every = shingles(self.question), shingles(self.answer), shingles(self.question + self.answer)


@dataclass
class Index:
    items: list[Item]
    terms: dict[bytes, int]
    postings: list[tuple[np.ndarray, np.ndarray]]  # of each term: item numbers, weights over the items' thresholds
    block_at: np.ndarray  # of each term: where its blocks start in the two arrays below
    block_id: np.ndarray
    block_most: np.ndarray  # largest weight of the term in the block
    block_from: np.ndarray  # where the block starts and ends in the term's postings
    block_to: np.ndarray
    most: np.ndarray  # of each term: largest weight
    stride: int


def build(rows: list[tuple[int, str, str]], overlap: float = 0.8) -> Index:
    """Index of (item_id, question, answer)."""
    items = [Item(i, words_of((q or "").encode()), words_of((a or "").encode())) for i, q, a in rows]
    items = [x for x in items if x.every]
    terms: dict[bytes, int] = {}
    counts = []
    for x in items:
        c: dict[int, int] = {}
        for w in x.question + x.answer:
            t = terms.setdefault(w, len(terms))
            c[t] = c.get(t, 0) + 1
        counts.append(c)
    df = np.zeros(len(terms))
    for c in counts:
        df[list(c)] += 1
    n = len(items)
    idf = np.log((n - df + 0.5) / (df + 0.5) + 1)
    size = np.array([sum(c.values()) for c in counts], float)
    lists: list[list[tuple[int, float]]] = [[] for _ in terms]
    for i, (x, c) in enumerate(zip(items, counts)):
        w = {t: idf[t] * f * (K1 + 1) / (f + K1 * (1 - B + B * size[i] / size.mean())) for t, f in c.items()}
        missing = int(np.floor((1 - overlap) * len(x.every) + 1e-9))
        least = max(sum(sorted(w.values())[: len(w) - missing]), 1e-9)
        for t, v in w.items():
            lists[t].append((i, v / least * (1 + 1e-9)))
    postings = [(np.array([i for i, _ in p]), np.array([v for _, v in p])) for p in lists]
    ids, most, starts, stops, at = [], [], [], [], [0]
    for i, v in postings:
        first = np.flatnonzero(np.concatenate([[True], i[1:] // BLOCK != i[:-1] // BLOCK]))
        ids.append(i[first] // BLOCK)
        most.append(np.maximum.reduceat(v, first))
        starts.append(first)
        stops.append(np.append(first[1:], len(i)))
        at.append(at[-1] + len(first))
    flat = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
    return Index(items, terms, postings, np.array(at), flat(ids, np.int64), flat(most, float), flat(starts, np.int64), flat(stops, np.int64), np.array([v.max() for _, v in postings]), max([64, *(len(x.question) + len(x.answer) for x in items)]))


def wand(lists: list[list]) -> list[tuple[int, float]]:
    """(item, score) of all items that reach 1; lists: [items, weights, position, largest weight] of one block, by term."""
    found = []
    while lists:
        lists.sort(key=lambda x: x[0][x[2]])
        total, pivot = 0.0, -1
        for k, x in enumerate(lists):
            total += x[3]
            if total >= 1:
                pivot = k
                break
        if pivot < 0:
            break  # no later item can reach the bound
        item = lists[pivot][0][lists[pivot][2]]
        if lists[0][0][lists[0][2]] == item:
            score = 0.0
            for x in lists:
                if x[0][x[2]] != item:
                    break
                score += x[1][x[2]]
                x[2] += 1
            if score >= 1:
                found.append((item, score))
        else:
            for x in lists[:pivot]:
                while x[2] < len(x[0]) and x[0][x[2]] < item:
                    x[2] += 1
        lists = [x for x in lists if x[2] < len(x[0])]
    return found


def search(index: Index, query: np.ndarray) -> list[tuple[int, float]]:
    """(item number, score over threshold) of all items that reach 1 for the distinct terms ``query``: block maxima first, then WAND in the blocks left."""
    a, b = index.block_at[query], index.block_at[query + 1]
    n = b - a
    of = np.repeat(np.arange(len(query)), n)
    flat = np.arange(len(of)) + np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
    block = index.block_id[flat]
    bound = np.bincount(block, index.block_most[flat])
    found = []
    for x in np.flatnonzero(bound >= 1).tolist():
        lists = []
        for k in np.flatnonzero(block == x).tolist():
            items, weights = index.postings[query[of[k]]]
            i, j = index.block_from[flat[k]], index.block_to[flat[k]]
            lists.append([items[i:j].tolist(), weights[i:j].tolist(), 0, float(index.block_most[flat[k]])])
        found += wand(lists)
    return found


def candidates(index: Index, ids: np.ndarray) -> list[tuple[int, int, list[tuple[int, float]]]]:
    """(start, stop, retrieved items) of each passage that retrieves any; ids: the text's terms, -1 if not in the index."""
    step = index.stride
    bound = np.concatenate([[0.0], np.cumsum(np.where(ids >= 0, index.most[ids], 0.0))])
    starts = np.arange(0, max(1, len(ids) - step), step)
    stops = np.minimum(starts + 2 * step, len(ids))
    out = []
    for k in np.flatnonzero(bound[stops] - bound[starts] >= 1 - 1e-6).tolist():
        a, b = int(starts[k]), int(stops[k])
        own = np.unique(ids[a:b])
        own = own[own >= 0]
        if index.most[own].sum() >= 1 - 1e-6 and (got := search(index, own)):
            out.append((a, b, got))
    return out


def leaks(index: Index, text: bytes, overlap: float = 0.8, each: float = 0.5) -> list[tuple[int, float, float, float, float]]:
    """(item_id, score, overlap, question overlap, answer overlap) of the items that a passage of the text holds."""
    words = words_of(text)
    if not words or not index.items:
        return []
    ids = np.fromiter(map(index.terms.get, words, repeat(-1)), np.int64, len(words))
    best: dict[int, tuple] = {}
    for a, b, got in candidates(index, ids):
        held = shingles(words[a:b])
        for i, score in got:
            x = index.items[i]
            own = held if len(x.question) + len(x.answer) >= SHINGLE else held | shingles(words[a:b], len(x.question) + len(x.answer))
            part = lambda s, w: 1.0 if not s else len(s & (own if len(w) >= SHINGLE else shingles(words[a:b], len(w)))) / len(s)  # noqa: B023, E731
            o = len(x.every & own) / len(x.every)
            if o >= overlap and min(parts := (part(x.q, x.question), part(x.a, x.answer))) >= each:
                best[x.item_id] = max(best.get(x.item_id, ()), (o, score, *parts))
    return [(i, s, o, q, a) for i, (o, s, q, a) in sorted(best.items())]


def split_items(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, question, answer): the answer is a text's last sentence, if it has several."""
    t = F.trim(F.coalesce(F.col(text_col), F.lit("")))
    cut = F.regexp_extract(t, r"(?s)^(.*[.!?])\s+([^.!?]+[.!?]*)$", 1)
    return items.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("item_id"), F.when(cut == "", t).otherwise(cut).alias("question"), F.when(cut == "", "").otherwise(F.regexp_extract(t, r"(?s)^(.*[.!?])\s+([^.!?]+[.!?]*)$", 2)).alias("answer"))


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", overlap: float = 0.8, each: float = 0.5, items_per_shard: int = 20_000) -> DataFrame:
    """(doc_id, item_id, score, overlap, question_overlap, answer_overlap) for items (item_id, question, answer)."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    items = items.where(F.col("item_id").isNotNull()).distinct()
    n = items.count()
    buckets = 1 if n <= items_per_shard else -(-2 * n // items_per_shard)  # half full on average
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = f"doc_id {d.schema['doc_id'].dataType.simpleString()}, item_id {items.schema['item_id'].dataType.simpleString()}, score double, overlap double, question_overlap double, answer_overlap double"
    names, item_type = [x.split()[0] for x in schema.split(", ")], to_arrow_type(items.schema["item_id"].dataType)

    def search(rows: list) -> tuple[DataFrame, object]:
        held = spark.sparkContext.broadcast(build(rows, overlap))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at, got = [], []
                for i, t in enumerate(raw_texts(b.column(1))):
                    for x in leaks(held.value, t, overlap, each):
                        at.append(i)
                        got.append(x)
                if got:
                    item, *shares = zip(*got)
                    yield pa.record_batch([b.column(0).take(pa.array(at)), pa.array(item, item_type), *(pa.array(c, pa.float64()) for c in shares)], names=names)

        return d.mapInArrow(run, schema), held

    out = None
    for s in range(buckets):
        own = items if buckets == 1 else items.where(F.pmod(F.xxhash64("item_id", "question", "answer"), F.lit(buckets)) == s)
        rows = [tuple(r) for r in own.orderBy("item_id", "question", "answer").toLocalIterator()]
        for i in range(0, max(1, len(rows)), items_per_shard):
            found, held = search(rows[i : i + items_per_shard])
            if n > items_per_shard:  # written, so that this shard can go before the next one comes
                found = scratch.stored(found, "leaks")
                held.destroy()
            out = found if out is None else out.union(found)
    return out
