"""Best documents of queries by BM25 and by words held, without a row for every pair: scores are made in tasks, and only what can be among the best leaves them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type


@dataclass
class Block:
    """Some queries: their ids and words, and for each word and query its weight, and 1 if the query holds it."""

    ids: list
    words: pa.Array
    weight: np.ndarray
    held: np.ndarray


def blocks(weights: DataFrame, size: int = 512) -> list[Block]:
    """``weights`` (qid, w, weight), a row for each distinct word of a query, in blocks of ``size`` queries."""
    by: dict = {}
    for r in weights.orderBy("qid", "w").collect():  # the query set, as many rows as it has words
        by.setdefault(r.qid, {})[r.w] = r.weight
    ids, out = list(by), []
    for k in range(0, len(ids), size):
        part = ids[k : k + size]
        words = sorted({w for q in part for w in by[q]})
        at = {w: i for i, w in enumerate(words)}
        weight, held = np.zeros((len(words), len(part))), np.zeros((len(words), len(part)))
        for j, q in enumerate(part):
            for w, x in by[q].items():
                weight[at[w], j], held[at[w], j] = x, 1
        out.append(Block(part, pa.array(words, pa.string()), weight, held))
    return out


def scores(batch: pa.RecordBatch, block: Block, avgdl: float, k1: float, b: float, cells: int = 1 << 21) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(start, stop, BM25, words held) of some of a batch's documents (doc_id, source, words: (w, dl, tf)) against a block's queries."""
    lists = batch.column("words")
    flat = lists.flatten()
    row = np.repeat(np.arange(len(batch)), np.diff(lists.offsets.to_numpy()))
    word = pc.fill_null(pc.index_in(flat.field("w"), block.words), -1).to_numpy()
    dl, tf = flat.field("dl").to_numpy(), flat.field("tf").to_numpy()
    asked = word >= 0
    row, word, part = row[asked], word[asked], (tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl)))[asked]
    step = max(1, cells // max(1, len(block.words), len(block.ids)))
    for i in range(0, len(batch), step):
        j = min(len(batch), i + step)
        at = slice(*np.searchsorted(row, (i, j)))
        grid = np.zeros((2, j - i, len(block.words)))
        np.add.at(grid[0], (row[at] - i, word[at]), part[at])
        np.add.at(grid[1], (row[at] - i, word[at]), 1)
        yield i, j, np.round(grid[0] @ block.weight, 9), grid[1] @ block.held


def first(ids: np.ndarray, n: int, *keys: np.ndarray) -> np.ndarray:
    """Places of the n first by ``keys``, highest first, ties to smaller ids."""
    if len(ids) > n:
        cut = np.partition(keys[0], len(ids) - n)[len(ids) - n]
        at = np.flatnonzero(keys[0] >= cut)
    else:
        at = np.arange(len(ids))
    order = np.unique(ids[at], return_inverse=True)[1]
    return at[np.lexsort((order, *[-k[at] for k in reversed(keys)]))[:n]]


def _ids(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def best(docs: DataFrame, asked: list[Block], qid: str, avgdl: float, k1: float, b: float, deep: int, dense: int, each_source: int = 0) -> DataFrame:
    """(qid, doc_id, source, s, held, way, matched, top): of each task the ``deep`` best by BM25 (way b), the ``dense`` best by words held (d) and the
    ``each_source`` best of each source by BM25 (s); ``matched`` and ``top``: the task's documents with a word of the query and their best BM25, on a row of way n."""
    types = [to_arrow_type(docs.schema["doc_id"].dataType), to_arrow_type(docs.schema["source"].dataType)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict = {}
        seen: dict = {}
        for batch in batches:
            who, source = _ids(batch.column("doc_id")), np.array(batch.column("source").to_pylist(), object)
            for block in asked:
                for i, j, s, held in scores(batch, block, avgdl, k1, b):
                    for q, name in enumerate(block.ids):
                        at = np.flatnonzero(held[:, q])
                        if not len(at):
                            continue
                        rows = (who[i:j][at], source[i:j][at], s[at, q], held[at, q])
                        n, top = seen.get(name, (0, -np.inf))
                        seen[name] = n + len(at), max(top, float(rows[2].max()))
                        for way, some in (("b", deep), ("d", dense)):
                            if some:
                                mine = [np.concatenate(x) for x in zip(kept[name, way], rows)] if (name, way) in kept else rows
                                best_of = first(mine[0], some, mine[2] if way == "b" else mine[3])
                                kept[name, way] = [x[best_of] for x in mine]
                        if each_source:
                            for of in set(rows[1].tolist()):
                                own = np.array([x == of for x in rows[1]])
                                mine = [x[own] for x in rows]
                                if (name, "s", of) in kept:
                                    mine = [np.concatenate(x) for x in zip(kept[name, "s", of], mine)]
                                kept[name, "s", of] = [x[first(mine[0], each_source, mine[2])] for x in mine]
        for (name, way, *_), (w, of, s, held) in kept.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(w), kind), pa.array(w.tolist(), types[0]), pa.array(of.tolist(), types[1]), pa.array(s), pa.array(held), pa.array([way] * len(w)), pa.nulls(len(w), pa.int64()), pa.nulls(len(w), pa.float64())], names=names)
        for name, (n, top) in seen.items():
            yield pa.RecordBatch.from_arrays([pa.array([name], kind), pa.nulls(1, types[0]), pa.nulls(1, types[1]), pa.nulls(1, pa.float64()), pa.nulls(1, pa.float64()), pa.array(["n"]), pa.array([n]), pa.array([top])], names=names)

    kind = pa.int32() if qid == "int" else pa.int64() if qid == "bigint" else pa.string()
    names = ["qid", "doc_id", "source", "s", "held", "way", "matched", "top"]
    return docs.select("doc_id", "source", "words").mapInArrow(run, f"qid {qid}, doc_id {docs.schema['doc_id'].dataType.simpleString()}, source {docs.schema['source'].dataType.simpleString()}, s double, held double, way string, matched long, top double")


def held_by(docs: DataFrame, asked: list[Block], qid: str, avgdl: float, k1: float, b: float, candidates: DataFrame) -> DataFrame:
    """(qid, doc_id, s, held, matched): BM25 and words held of those of ``candidates`` (qid, doc_id) that hold a word of the query; on rows without doc_id how many of a task's documents do."""
    wanted: dict = {}
    for r in candidates.select("qid", "doc_id").distinct().collect():  # some dozens a query
        wanted.setdefault(r.qid, []).append(r.doc_id)
    of = {q: np.array(x) for q, x in wanted.items()}
    any_of = np.unique(np.concatenate(list(of.values()))) if of else np.zeros(0, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict = {}
        for batch in batches:
            who = _ids(batch.column("doc_id"))
            some = np.isin(who, any_of)
            for block in asked:
                for i, j, s, held in scores(batch, block, avgdl, k1, b):
                    near = np.flatnonzero(some[i:j])
                    for name, n in zip(block.ids, np.count_nonzero(held, 0).tolist()):
                        seen[name] = seen.get(name, 0) + n
                    for q, name in enumerate(block.ids):
                        at = near[held[near, q] > 0]
                        at = at[np.isin(who[i:j][at], of[name])] if name in of and len(at) else at[:0]
                        if len(at):
                            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), kind), pa.array(who[i:j][at].tolist(), id_type), pa.array(s[at, q]), pa.array(held[at, q]), pa.nulls(len(at), pa.int64())], names=names)
        if seen:
            n = len(seen)
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), kind), pa.nulls(n, id_type), pa.nulls(n, pa.float64()), pa.nulls(n, pa.float64()), pa.array(list(seen.values()), pa.int64())], names=names)

    kind = pa.int32() if qid == "int" else pa.int64() if qid == "bigint" else pa.string()
    id_type, names = to_arrow_type(docs.schema["doc_id"].dataType), ["qid", "doc_id", "s", "held", "matched"]
    return docs.select("doc_id", "source", "words").mapInArrow(run, f"qid {qid}, doc_id {docs.schema['doc_id'].dataType.simpleString()}, s double, held double, matched long")


def before(value: np.ndarray, ids: np.ndarray, wanted: np.ndarray, wanted_ids: np.ndarray) -> np.ndarray:
    """For each of ``wanted`` how many of ``value`` are higher, or equal with a smaller id."""
    held = np.sort(value)
    low, high = np.searchsorted(held, wanted, "left"), np.searchsorted(held, wanted, "right")
    out = len(held) - high
    for v in np.unique(wanted[low < high]):
        own = wanted == v
        out[own] += np.searchsorted(np.sort(ids[value == v]), wanted_ids[own], "left")
    return out


def places(docs: DataFrame, asked: list[Block], qid: str, avgdl: float, k1: float, b: float, candidates: DataFrame) -> DataFrame:
    """(qid, doc_id, s, held, rb, rd): the ranks by BM25 and by words held, among all documents that hold a word of the query, of ``candidates`` (qid, doc_id, s, held)."""
    wanted: dict = {}
    for r in candidates.select("qid", "doc_id", "s", "held").distinct().orderBy("qid", "doc_id").collect():  # some dozens a query
        wanted.setdefault(r.qid, []).append((r.doc_id, r.s, r.held))
    held_of = {q: (np.array([x[0] for x in rows]), *np.array([x[1:] for x in rows], float).T) for q, rows in wanted.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = {q: np.zeros((2, len(x[0])), np.int64) for q, x in held_of.items()}
        for batch in batches:
            who = _ids(batch.column("doc_id"))
            for block in asked:
                for i, j, s, held in scores(batch, block, avgdl, k1, b):
                    for q, name in enumerate(block.ids):
                        at = np.flatnonzero(held[:, q])
                        if len(at) and name in held_of:
                            ids, by_s, by_held = held_of[name]
                            count[name][0] += before(s[at, q], who[i:j][at], by_s, ids)
                            count[name][1] += before(held[at, q], who[i:j][at], by_held, ids)
        for name, (b_, d_) in count.items():
            n = len(b_)
            yield pa.RecordBatch.from_arrays([pa.array([name] * n, kind), pa.array(held_of[name][0].tolist(), id_type), pa.array(held_of[name][1]), pa.array(held_of[name][2]), pa.array(b_), pa.array(d_)], names=["qid", "doc_id", "s", "held", "rb", "rd"])

    kind = pa.int32() if qid == "int" else pa.int64() if qid == "bigint" else pa.string()
    id_type = to_arrow_type(docs.schema["doc_id"].dataType)
    parts = docs.select("doc_id", "source", "words").mapInArrow(run, f"qid {qid}, doc_id {docs.schema['doc_id'].dataType.simpleString()}, s double, held double, rb long, rd long")
    return parts.groupBy("qid", "doc_id", "s", "held").agg((F.sum("rb") + 1).cast("int").alias("rb"), (F.sum("rd") + 1).cast("int").alias("rd"))
