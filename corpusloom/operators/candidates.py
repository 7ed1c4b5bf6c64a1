"""Candidates of queries among all chunks by vectors and by BM25, without a row for every pair: scores are made in tasks, and only what can be returned leaves them.

A vector is the signed count of a text's words in ``DIM`` cells by MD5, so DuckDB can make it, too; products of whole numbers are exact. A chunk is a row
(doc_id, source, summary, dl, cells, square, words, tf) that ``packed`` makes of a text; ``words`` are places in the sorted list of words that queries hold.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corpusloom.operators.lexical import before
from corpusloom.operators.likeness import listed
from corpusloom.session import stored

#: Cells of a vector; chunks that are scored at once, rows of a grid of their words, queries of a block.
DIM, CHUNKS, GRID, QUERIES = 256, 4096, 512, 512


def cells_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Cell and sign of each word."""
    hashes = np.array([int.from_bytes(hashlib.md5(w.encode()).digest()[8:], "little") for w in words], np.uint64)
    return (hashes % np.uint64(DIM)).astype(np.int64), np.where(hashes >> np.uint64(63), 1, -1)


@dataclass
class Asked:
    """Queries of a block: their ids, vectors and squares, and ``slots``: a query's distinct words as places and weights, none is place 0 with weight 0."""

    ids: list
    vectors: np.ndarray
    squares: np.ndarray
    places: np.ndarray
    weights: np.ndarray


def asked_blocks(queries: list[tuple], words: list[str], weigh=None) -> list[Asked]:
    """``queries`` (id, words with repeats) in blocks of ``QUERIES``; ``weigh`` gives a word's weight, ``words`` is the sorted list of them all."""
    cell, sign = cells_of(words)
    at, out = {w: i for i, w in enumerate(words)}, []
    for k in range(0, len(queries), QUERIES):
        part = queries[k : k + QUERIES]
        vectors, most = np.zeros((len(part), DIM)), max(1, *(len(set(q)) for _, q in part))
        places, weights = np.zeros((len(part), most), np.int64), np.zeros((len(part), most))
        for i, (_, q) in enumerate(part):
            np.add.at(vectors[i], cell[[at[w] for w in q]], sign[[at[w] for w in q]])
            own = sorted({at[w] for w in q})
            places[i, : len(own)] = own
            weights[i, : len(own)] = [q.count(words[j]) * weigh[j] for j in own] if weigh is not None else 0
        out.append(Asked([name for name, _ in part], vectors, (vectors * vectors).sum(1), places, weights))
    return out


def unique(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, source, text) with ids, one row each; of rows that repeat an id the first by source and text, as a store that is written by id holds one. Only such rows are shuffled."""
    docs = docs.where("doc_id IS NOT NULL")
    repeated = stored(docs.groupBy(F.col("doc_id").alias("of")).count().where("count > 1").select("of"), "repeated")
    if not repeated.limit(1).count():
        return docs
    same = F.col("doc_id") == F.col("of")
    first = F.min(F.struct(F.col("source").isNull().alias("a"), "source", F.col("text").isNull().alias("b"), "text")).alias("x")
    many = docs.join(repeated, same, "left_semi").groupBy("doc_id").agg(first).select("doc_id", "x.source", "x.text")
    return docs.join(repeated, same, "left_anti").unionByName(many)


def packed(chunks: DataFrame, asked: list[str]) -> DataFrame:
    """Chunks as the module has them, of ``chunks`` (doc_id, source, summary, words), these joined by spaces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), CHUNKS):
                b = batch.slice(at, CHUNKS)
                parted = pc.split_pattern(b.column("words"), " ")
                coded = parted.flatten().dictionary_encode()
                code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                row = np.repeat(np.arange(len(b)), pc.list_value_length(parted).to_numpy(zero_copy_only=False))
                real = pc.greater(pc.utf8_length(coded.dictionary), 0).to_numpy(zero_copy_only=False).astype(bool)[code]
                code, row = code[real], row[real]
                cell, sign = cells_of(coded.dictionary.to_pylist())
                cells = np.bincount(row * DIM + cell[code], sign[code], len(b) * DIM).reshape(len(b), DIM).astype(np.int64)
                held = pc.fill_null(pc.index_in(coded.dictionary, pa.array(asked, pa.string())), -1).to_numpy()[code]
                key, tf = np.unique((row * max(1, len(asked)) + held)[held >= 0], return_counts=True)
                of, word = np.divmod(key, max(1, len(asked)))
                sizes = np.bincount(of, minlength=len(b))
                columns = [pa.array(np.bincount(row, minlength=len(b)), pa.int64()), listed(pa.array(cells.ravel(), pa.int32()), np.full(len(b), DIM)), pa.array((cells * cells).sum(1), pa.int64()), listed(pa.array(word, pa.int32()), sizes), listed(pa.array(tf, pa.int32()), sizes)]
                yield pa.RecordBatch.from_arrays([b.column(c) for c in ("doc_id", "source", "summary")] + columns, names=["doc_id", "source", "summary", "dl", "cells", "square", "words", "tf"])

    of = lambda c: chunks.schema[c].dataType.simpleString()
    return stored(chunks.select("doc_id", "source", "summary", "words").mapInArrow(run, f"doc_id {of('doc_id')}, source {of('source')}, summary boolean, dl long, cells array<int>, square long, words array<int>, tf array<int>"), "chunks")


def statistics(chunks: DataFrame, asked: list[str]) -> tuple[int, float, np.ndarray]:
    """Chunks, their mean length, and for each of ``asked`` how many hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, length, df = 0, 0, np.zeros(len(asked), np.int64)
        for b in batches:
            n, length = n + len(b), length + (pc.sum(b.column("dl")).as_py() or 0)
            df += np.bincount(b.column("words").flatten().to_numpy(), minlength=len(asked))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-2, len(asked)), pa.int32()), pa.array([n, length, *df.tolist()], pa.int64())], names=["w", "n"])

    rows = {r.w: r.n for r in chunks.select("dl", "words").mapInArrow(run, "w int, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()}  # as many as words asked
    n = rows.get(-2, 0)
    return n, rows.get(-1, 0) / max(1, n), np.array([rows.get(i, 0) for i in range(len(asked))], np.int64)


def cosines(b: pa.RecordBatch, block: Asked) -> np.ndarray:
    """(queries, chunks): 0 where either has no words."""
    dot = block.vectors @ b.column("cells").flatten().to_numpy().reshape(len(b), DIM).astype(float).T
    return np.divide(dot, np.sqrt(block.squares[:, None] * b.column("square").to_numpy().astype(float)), out=np.zeros_like(dot), where=dot != 0)


def bm25(b: pa.RecordBatch, block: Asked, many: int, avgdl: float, k1: float, b_: float) -> tuple[np.ndarray, np.ndarray]:
    """(queries, chunks): BM25 to nine digits, and words held; a query's words are added in their order, so that a pair's score is the same in any batch."""
    dl, lists = b.column("dl").to_numpy(), b.column("words")
    row = np.repeat(np.arange(len(b)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    word, tf = lists.flatten().to_numpy(), b.column("tf").flatten().to_numpy().astype(float)
    part = tf * (k1 + 1) / (tf + k1 * (1 - b_ + b_ * dl[row] / avgdl))
    s, held = np.zeros((2, len(block.ids), len(b)))
    for i in range(0, len(b), GRID):
        j = min(len(b), i + GRID)
        at = slice(*np.searchsorted(row, (i, j)))
        grid = np.zeros((many, j - i))
        grid[word[at], row[at] - i] = part[at]
        for places, weights in zip(block.places.T, block.weights.T):
            some = grid[places] * weights[:, None]
            s[:, i:j] += some
            held[:, i:j] += some > 0
    return np.round(s, 9), held


def _kinds(qid: str, chunks: DataFrame) -> list[pa.DataType]:
    return [pa.int32() if qid == "int" else pa.int64() if qid == "bigint" else pa.string(), to_arrow_type(chunks.schema["doc_id"].dataType), to_arrow_type(chunks.schema["source"].dataType)]


def _ids(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def _sources(column: pa.Array) -> tuple[list, np.ndarray]:
    coded = column.dictionary_encode(null_encoding="encode")
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def nearest(chunks: DataFrame, blocks: list[Asked], qid: str, most: int) -> DataFrame:
    """(qid, wording, doc_id, source, summary, sim): of each task the ``most`` chunks of each source nearest to each wording of a query, ties to smaller ids; a wording's id is (qid, wording)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict = {}
        for batch in batches:
            for at in range(0, len(batch), CHUNKS):
                b = batch.slice(at, CHUNKS)
                who, summary, (names, of) = _ids(b.column("doc_id")), _ids(b.column("summary")), _sources(b.column("source"))
                for k, block in enumerate(blocks):
                    sims = cosines(b, block)
                    for c, name in enumerate(names):
                        own = np.flatnonzero(of == c)
                        x = sims[:, own]
                        cut = np.partition(x, len(own) - most, 1)[:, len(own) - most, None] if len(own) > most else -np.inf
                        q, j = np.nonzero(x >= cut)
                        rows = [q, who[own[j]], summary[own[j]], x[q, j]]
                        if (k, name) in kept:
                            rows = [np.concatenate(z) for z in zip(kept[k, name], rows)]
                        order = np.lexsort((np.unique(rows[1], return_inverse=True)[1], -rows[3], rows[0]))
                        q = rows[0][order]
                        order = order[np.arange(len(q)) - np.searchsorted(q, q) < most]
                        kept[k, name] = [z[order] for z in rows]
        for (k, name), (q, who, summary, sim) in kept.items():
            ids = [blocks[k].ids[i] for i in q.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in ids], types[0]), pa.array([w for _, w in ids], pa.int32()), pa.array(who.tolist(), types[1]), pa.array([name] * len(q), types[2]), pa.array(summary.astype(bool)), pa.array(sim)], names=["qid", "wording", "doc_id", "source", "summary", "sim"])

    types = _kinds(qid, chunks)
    kinds = [chunks.schema[c].dataType.simpleString() for c in ("doc_id", "source")]
    return chunks.select("doc_id", "source", "summary", "cells", "square").mapInArrow(run, f"qid {qid}, wording int, doc_id {kinds[0]}, source {kinds[1]}, summary boolean, sim double")


def layers(seq: np.ndarray, k: int) -> np.ndarray:
    """Which of ``seq`` are lower than all before them, or would be without those found before; ``k`` rounds."""
    keep, left = np.zeros(len(seq), bool), np.arange(len(seq))
    for _ in range(k):
        x = seq[left]
        low = np.concatenate([[True], x[1:] < np.minimum.accumulate(x)[:-1]])[: len(x)]
        keep[left[low]] = True
        left = left[~low]
    return keep


def undominated(ids: np.ndarray, of: np.ndarray, sim: np.ndarray, s: np.ndarray, pool: int, each: int) -> np.ndarray:
    """Places of all that can be among the ``pool`` best of a query, or the ``each`` best of their source, by any score that falls with both ranks: those after fewer others by vector and by BM25 both."""
    order, by = np.lexsort((ids, -sim)), np.empty(len(ids), np.int64)
    by[np.lexsort((ids, -s))] = np.arange(len(ids))
    keep = np.zeros(len(ids), bool)
    keep[order] = layers(by[order], pool)
    own = order[np.argsort(-of[order], kind="stable")]
    keep[own] |= layers(by[own] + of[own] * len(ids), each)  # a source's places are all below those of the one before
    return np.flatnonzero(keep)


def fused_few(chunks: DataFrame, blocks: list[Asked], qid: str, many: int, avgdl: float, k1: float, b_: float, pool: int, each: int) -> DataFrame:
    """(qid, doc_id, source, sim, s, held) of each query what is ``undominated`` among all chunks."""
    names = ["qid", "doc_id", "source", "sim", "s", "held"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, seen = {}, {}
        for batch in batches:
            for at in range(0, len(batch), CHUNKS):
                b = batch.slice(at, CHUNKS)
                who, (of_names, of) = _ids(b.column("doc_id")), _sources(b.column("source"))
                of = np.array([seen.setdefault(x, len(seen)) for x in of_names], np.int64)[of]
                for block in blocks:
                    sims, (s, held) = cosines(b, block), bm25(b, block, many, avgdl, k1, b_)
                    for q, name in enumerate(block.ids):
                        rows = [who, of, sims[q], s[q], held[q]]
                        if name in kept:
                            rows = [np.concatenate(z) for z in zip(kept[name], rows)]
                        few = undominated(np.unique(rows[0], return_inverse=True)[1], *rows[1:4], pool, each)
                        kept[name] = [z[few] for z in rows]
        sources = list(seen)
        for name, (who, of, *numbers) in kept.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(who), types[0]), pa.array(who.tolist(), types[1]), pa.array([sources[i] for i in of.tolist()], types[2]), *map(pa.array, numbers)], names=names)

    def merged(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        one = lambda c: rows[c].combine_chunks()
        _, of = _sources(one("source"))
        few = undominated(np.unique(_ids(one("doc_id")), return_inverse=True)[1], of, _ids(one("sim")), _ids(one("s")), pool, each)
        return rows.take(pa.array(few))

    types = _kinds(qid, chunks)
    kinds = [chunks.schema[c].dataType.simpleString() for c in ("doc_id", "source")]
    schema = f"qid {qid}, doc_id {kinds[0]}, source {kinds[1]}, sim double, s double, held double"
    return chunks.drop("summary").mapInArrow(run, schema).groupBy("qid").applyInArrow(merged, schema)


def ranks_of_few(chunks: DataFrame, blocks: list[Asked], qid: str, many: int, avgdl: float, k1: float, b_: float, few: DataFrame) -> DataFrame:
    """``few`` (qid, doc_id, sim, s and others) with rd and rb, their ranks by vector and by BM25 among all chunks, ties to smaller ids."""
    wanted: dict = {}
    for r in few.select("qid", "doc_id", "sim", "s").orderBy("qid", "doc_id").collect():  # some hundreds a query
        wanted.setdefault(r.qid, []).append((r.doc_id, r.sim, r.s))
    of = {q: (np.array([x[0] for x in rows]), *np.array([x[1:] for x in rows], float).T) for q, rows in wanted.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = {q: np.zeros((2, len(x[0])), np.int64) for q, x in of.items()}
        for batch in batches:
            for at in range(0, len(batch), CHUNKS):
                b = batch.slice(at, CHUNKS)
                who = _ids(b.column("doc_id"))
                for block in blocks:
                    sims, (s, _) = cosines(b, block), bm25(b, block, many, avgdl, k1, b_)
                    for q, name in enumerate(block.ids):
                        ids, sim, score = of[name]
                        count[name][0] += before(sims[q], who, sim, ids)
                        count[name][1] += before(s[q], who, score, ids)
        for name, (rd, rb) in count.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(rd), types[0]), pa.array(of[name][0].tolist(), types[1]), pa.array(rd), pa.array(rb)], names=["_q", "_d", "rd", "rb"])

    types = _kinds(qid, chunks)
    counted = chunks.drop("summary").mapInArrow(run, f"_q {qid}, _d {chunks.schema['doc_id'].dataType.simpleString()}, rd long, rb long").groupBy("_q", "_d").agg((F.sum("rd") + 1).alias("rd"), (F.sum("rb") + 1).alias("rb"))
    return few.join(counted, (F.col("qid") == F.col("_q")) & (F.col("doc_id") == F.col("_d"))).drop("_q", "_d")
