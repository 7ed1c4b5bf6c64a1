"""Weights of words and likeness of sentences, made in the task that reads a text: no row for a word or a pair is shuffled.

Some ``DOCUMENTS`` are held at a time, and of a document's graph ``summarize.BLOCK`` rows, or all if it has few sentences.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.dialect import SPARK
from corpusloom.functions.text import STOP_WORDS, WORD_A, sentences_raw, tok_c
from corpusloom.operators.overlap import together
from corpusloom.operators.summarize import BLOCK, Rows, graph_rows, select

#: Documents that are weighed at once; rows that leave at once.
DOCUMENTS, ROWS = 128, 1 << 17


@dataclass
class Weights:
    """Of some documents a row for each word of a sentence: document, sentence (from 1), word and weight, in this order; and for each sentence of a text, empty ones included, its document and place."""

    doc: np.ndarray
    i: np.ndarray
    word: np.ndarray
    x: np.ndarray
    words: pa.Array
    all_doc: np.ndarray
    all_i: np.ndarray

    def graph(self, k: int) -> tuple[np.ndarray, Rows]:
        """Places of document ``k``'s sentences that hold words, and their weights."""
        at = slice(*np.searchsorted(self.doc, (k, k + 1)))
        places, row = np.unique(self.i[at], return_inverse=True)
        held, col = np.unique(self.word[at], return_inverse=True)
        return places, Rows(row, col, self.x[at], len(places), len(held))


def taken(m: Rows, rows: np.ndarray) -> Rows:
    """The given rows of ``m``, in their order."""
    starts = np.searchsorted(m.row, np.arange(m.n + 1))
    size = np.diff(starts)[rows]
    at = np.repeat(starts[rows] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    return Rows(np.repeat(np.arange(len(rows)), size), m.col[at], m.val[at], len(rows), m.m)


def classes(m: Rows, *beside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class of each row of ``m``, and the first row of each class: rows that are equal, as are the values ``beside`` them."""
    starts = np.searchsorted(m.row, np.arange(m.n + 1)).tolist()
    seen: dict = {}
    of = np.array([seen.setdefault((m.col[a:b].tobytes(), m.val[a:b].tobytes(), *[x[r] for x in beside]), len(seen)) for r, (a, b) in enumerate(zip(starts, starts[1:]))], np.int64)
    return of, np.unique(of, return_index=True)[1]


def graph_of(m: Rows) -> Iterator[tuple[int, np.ndarray]]:
    """As ``summarize.graph_rows``, from the first row's column on; products are made for one row of those that are equal, if these are few."""
    of, first = classes(m)
    if len(first) == m.n or len(first) > 4 * BLOCK:
        yield from ((a, w[:, a:]) for a, w in graph_rows(m))
        return
    some = np.concatenate([w for _, w in graph_rows(taken(m, first))])
    np.fill_diagonal(some, 1.0)
    for a in range(0, m.n, BLOCK):
        w = some[of[a : a + BLOCK]].take(of[a:], 1)
        np.fill_diagonal(w, 0)
        yield a, w


def weigh(texts: pa.Array) -> Weights:
    """``texts``: for each document its texts as lists of sentences, these as words joined by spaces; stop words and single letters are left out.

    A word's weight is its share of the sentence times ln((1 + n) / (1 + df)) + 1, L2-normalised by sentence; n: the document's
    sentences. Sentences that have the same place in texts of one document count as one, but each in n.
    """
    lengths = lambda a: pc.list_value_length(a).to_numpy(zero_copy_only=False).astype(np.int64)
    per_doc, lists = lengths(texts), texts.flatten()
    per_text, sentences = lengths(lists), lists.flatten()
    all_doc = np.repeat(np.repeat(np.arange(len(texts)), per_doc), per_text)
    all_i = np.arange(len(all_doc)) - np.repeat(np.cumsum(per_text) - per_text, per_text) + 1
    parted = pc.split_pattern(sentences, " ")
    per_sentence, flat = lengths(parted), parted.flatten()
    coded = flat.dictionary_encode()
    content = pc.and_(pc.greater(pc.utf8_length(coded.dictionary), 1), pc.invert(pc.is_in(coded.dictionary, pa.array(STOP_WORDS))))
    real = content.take(coded.indices).to_numpy(zero_copy_only=False).astype(bool)
    many, most = max(1, len(coded.dictionary)), int(all_i.max(initial=0)) + 1
    key = (np.repeat(all_doc * most + all_i, per_sentence) * many + coded.indices.to_numpy(zero_copy_only=False))[real]
    key, c = np.unique(key, return_counts=True)
    sentence, word = np.divmod(key, many)
    doc, i = np.divmod(sentence, most)
    own = np.cumsum(np.diff(sentence, prepend=-1) != 0) - 1
    _, pair, df = np.unique(doc * many + word, return_inverse=True, return_counts=True)
    n = np.bincount(all_doc, minlength=len(texts))[doc]
    x = c / np.bincount(own, c)[own] * (np.log((1.0 + n) / (1.0 + df[pair])) + 1) if len(key) else np.zeros(0)
    x = x / np.sqrt(np.bincount(own, x * x))[own] if len(key) else x
    return Weights(doc, i, word, x, coded.dictionary, all_doc, all_i)


def weighed(docs: DataFrame, f: Callable[[Weights], Iterator[tuple]], columns: str, key: str = "doc_id") -> DataFrame:
    """(key, ``columns``) of ``docs`` (key, text): ``f`` makes (rows' documents, columns) of the weights of some documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), DOCUMENTS):
                part = b.slice(at, DOCUMENTS)
                for doc, *values in f(weigh(part.column(1))):
                    for k in range(0, len(doc), ROWS):
                        rows = [part.column(0).take(pa.array(doc[k : k + ROWS])), *[v.slice(k, ROWS) if isinstance(v, pa.Array) else pa.array(v[k : k + ROWS]) for v in values]]
                        yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(rows, [part.column(0).type, *types])], names=names)

    kinds = {"int": pa.int32(), "double": pa.float64(), "string": pa.string()}
    names, types = [key, *[c.split()[0] for c in columns.split(", ")]], [kinds[c.split()[1]] for c in columns.split(", ")]
    words = SPARK.map(sentences_raw(SPARK, "text"), f"lower({SPARK.join(SPARK.rx_all('s', WORD_A), ' ')})", "s")
    rows = together(docs.select(key, F.expr(words).alias("sentences")), key)
    return rows.mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, {columns}")


#: Words that explanations leave out, sentences of a summary, keywords of a sentence, the ranks that count as the highest, and reasons.
EXPLAIN_STOPS = ("và", "là", "của", "có", "cho", "các", "một", "những", "được", "trong", "với", "khi", "từ", "đã", "này", "đó", "về", "theo", "tại", "ra")
SUMMARY, KEYWORDS, HIGH = 5, 5, 3
REASONS = ("Câu này nằm trong nhóm câu có điểm quan trọng cao nhất và chứa các từ khóa nổi bật: {}.", "Câu này khớp trực tiếp với câu trong bản tóm tắt (độ tương đồng {:.2f}) và chứa: {}.", "các từ khóa chính")


def listed(values: pa.Array, sizes: np.ndarray) -> pa.Array:
    """``values`` in lists of ``sizes``."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values)


def editorial(s: pa.Array, low: pa.Array) -> np.ndarray:
    """Which of the sentences ``s``, in lower case ``low``, are lines as ``text.editorial_line`` has them."""
    held = lambda a, p: pc.match_substring_regex(a, p).to_numpy(zero_copy_only=False).astype(bool)
    credit = held(low, "(^|[^a-zà-ỹđ])ảnh *:") | held(low, "^theo +(vne|vnexpress)")
    return held(s, "^[0-9]{1,3}$") | held(s, "^[0-9]+ */ *[0-9]+$") | (credit & (pc.utf8_length(s).to_numpy() < 150))


def summary_picks(s: pa.Array, content: pa.Array, doc: np.ndarray, docs: int) -> np.ndarray:
    """Places of the sentences that make each document's summary: ``SUMMARY`` greedy picks by tf-idf among those that are neither editorial lines nor repeated; scores to six digits of the highest."""
    low = pc.utf8_lower(s)
    head = pc.utf8_slice_codeunits(low, 0, 160).dictionary_encode()
    some = np.flatnonzero(~editorial(s, low))
    code = head.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    fit = np.sort(some[np.unique(doc[some] * max(1, len(head.dictionary)) + code[some], return_index=True)[1]])
    many = np.bincount(doc[fit], minlength=docs)
    m = weigh(listed(listed(content.take(pa.array(fit)), many), np.ones(docs, np.int64)))
    starts = np.cumsum(many) - many
    score = np.bincount(starts[m.doc] + m.i - 1, m.x, len(fit))
    out = []
    for a, n in zip(starts.tolist(), many.tolist()):
        own = score[a : a + n]
        out.append(fit[a : a + n][select(np.floor(own / max(own.max(), 1e-12) * 1e6 + 0.5) / 1e6, SUMMARY)] if n > SUMMARY else fit[a : a + n])
    return np.concatenate(out) if out else fit


def explain(texts: pa.Array) -> tuple:
    """(document, nth, summary sentence, place from 1, sentence, rank, similarity, keywords, reason) of the sentences of summaries; ``texts``: for each document its sentences (s, words, content).

    The picks of a summary are joined by spaces and parted again, so one that ends without . ! or ? goes on in the next.
    """
    per_doc = pc.list_value_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    s, words, content = (texts.flatten().field(k) for k in ("s", "words", "content"))
    doc, starts = np.repeat(np.arange(len(texts)), per_doc), np.cumsum(per_doc) - per_doc
    n, place = len(s), np.arange(len(s)) - starts[doc]
    parted = pc.split_pattern(words, " ")
    coded = parted.flatten().dictionary_encode()
    many = max(1, len(coded.dictionary))
    real = pc.and_(pc.greater(pc.utf8_length(coded.dictionary), 1), pc.invert(pc.is_in(coded.dictionary, pa.array(EXPLAIN_STOPS)))).take(coded.indices).to_numpy(zero_copy_only=False).astype(bool)
    key = np.repeat(np.arange(n), pc.list_value_length(parted).to_numpy(zero_copy_only=False)) * many + coded.indices.to_numpy(zero_copy_only=False)
    key, first, count = np.unique(key[real], return_index=True, return_counts=True)
    of, word = np.divmod(key, many)
    size = np.bincount(of, minlength=n)

    _, at, df = np.unique(doc[of] * many + word, return_inverse=True, return_counts=True)
    score = np.round(np.bincount(of, np.log((per_doc[doc[of]] + 1.0) / (df[at] + 1.0)) + 1, n) + np.minimum(size, 30) / 30, 9)
    order = np.lexsort((-place, -score, doc))
    rank = np.empty(n, np.int64)
    rank[order] = place + 1  # documents follow each other in both orders

    picks = summary_picks(s, content, doc, len(texts))
    ends = pc.match_substring_regex(s.take(pa.array(picks)), "[.!?]$").to_numpy(zero_copy_only=False).astype(bool)
    begins = (np.diff(doc[picks], prepend=-1) != 0) | np.concatenate([[True], ends[:-1]])[: len(picks)]
    run_of = np.full(n, -1)
    run_of[picks] = np.cumsum(begins) - 1
    run_doc = doc[picks[begins]]
    runs = len(run_doc)
    nth = np.arange(runs) - np.searchsorted(run_doc, run_doc)
    held = np.unique(run_of[of[run_of[of] >= 0]] * many + word[run_of[of] >= 0])
    run_size = np.bincount(held // many, minlength=runs)
    best, alike = np.zeros(runs, np.int64), np.zeros(runs)
    for k in range(int(nth.max(initial=-1)) + 1):
        run_at = np.full(len(texts), -1)
        run_at[run_doc[nth == k]] = np.flatnonzero(nth == k)
        asked = run_at[doc]
        hits = np.bincount(of[np.isin(np.where(asked[of] >= 0, asked[of] * many + word, -1), held)], minlength=n)
        with np.errstate(invalid="ignore"):
            same = np.where(hits > 0, hits / (size + run_size[asked] - hits), 0.0)
        order = np.lexsort((place, -same, doc))
        order = order[asked[order] >= 0]
        top = order[np.unique(doc[order], return_index=True)[1]]
        best[asked[top]], alike[asked[top]] = top, same[top]

    frequent = np.lexsort((first, -count, of))
    few = np.minimum(size[best], KEYWORDS)
    places = np.repeat(np.searchsorted(of, best) - (np.cumsum(few) - few), few) + np.arange(few.sum())
    keywords = pc.binary_join(listed(coded.dictionary.take(pa.array(word[frequent[places]])), few), ", ").to_pylist()
    reasons = [REASONS[0].format(k or REASONS[2]) if r <= HIGH else REASONS[1].format(x, k or REASONS[2]) for k, r, x in zip(keywords, rank[best].tolist(), alike.tolist())]
    joined = pc.binary_join(listed(s.take(pa.array(picks)), np.bincount(run_of[picks], minlength=runs)), " ")
    return run_doc, nth + 1, joined, place[best] + 1, s.take(pa.array(best)), rank[best], np.floor(alike * 1e4 + 0.5) / 1e4, keywords, reasons


def explanations(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Why each sentence of a text's summary is in it: its best match among all sentences of the text by the words they share (Jaccard, ties to the earlier), that sentence's
    rank of importance, its most frequent words (ties as they come) and a reason. Each row of ``docs`` (key, text) is a text; the summary: ``summary_picks``.

    A sentence's importance: its distinct words by ln((n + 1) / (df + 1)) + 1, and a thirtieth for each up to thirty; ties to the later sentence.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), DOCUMENTS):
                part = b.slice(at, DOCUMENTS)
                doc, *columns = explain(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(doc)), *[c.cast(t) if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types)]], names=[key, *names])

    names = ["nth", "summary_sentence", "i", "sentence", "importance_rank", "similarity", "keywords", "reason"]
    types = [pa.int32(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.float64(), pa.string(), pa.string()]
    fields = {"s": "s", "words": SPARK.join(tok_c(SPARK, "s"), " "), "content": f"lower({SPARK.join(SPARK.rx_all('s', WORD_A), ' ')})"}
    rows = SPARK.map(sentences_raw(SPARK, "text"), f"named_struct({', '.join(f'{SPARK.lit(k)}, {v}' for k, v in fields.items())})", "s")
    return docs.select(key, F.expr(rows).alias("rows")).mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, nth int, summary_sentence string, i int, sentence string, importance_rank int, similarity double, keywords string, reason string")


def pairs(docs: DataFrame, more_than: float = 0.0, most: int | None = None, key: str = "doc_id") -> DataFrame:
    """(key, i, j, sim) of each two sentences i < j of a document with a cosine above ``more_than``, rounded to six digits; of each document the ``most`` highest, ties to smaller i, then j.

    Of equal sentences none after the first ``most`` can be in those: pairs with the earlier ones rank before.
    """

    def f(m: Weights) -> Iterator[tuple]:
        held, size = [], 0
        for k in np.unique(m.doc).tolist():
            places, rows = m.graph(k)
            if most is not None:
                order = np.argsort(of := classes(rows)[0], kind="stable")
                nth = np.arange(len(of)) - np.searchsorted(of[order], of[order])
                early = np.sort(order[nth <= most])
                places, rows = places[early], taken(rows, early)
            best = None
            for a, w in graph_of(rows):
                i, j = np.nonzero(w > more_than)
                upper = j > i
                i, j = i[upper], j[upper]
                found = [np.full(len(i), k), places[i + a], places[j + a], np.round(w[i, j], 6)]
                if most is None:
                    held.append(found)
                    size += len(i)
                    if size >= ROWS:
                        yield tuple(map(np.concatenate, zip(*held)))
                        held, size = [], 0
                    continue
                best = found if best is None else [np.concatenate(c) for c in zip(best, found)]
                if len(best[3]) > most:
                    high = best[3] >= np.partition(best[3], len(best[3]) - most)[len(best[3]) - most]
                    best = [c[high] for c in best]
                best = [c[np.lexsort((best[2], best[1], -best[3]))[:most]] for c in best]
            if best is not None:
                held.append(best)
        if held:
            yield tuple(map(np.concatenate, zip(*held)))

    return weighed(docs.where(F.col(key).isNotNull()), f, "i int, j int, sim double", key)


def node_ranks(m: Weights, k: int, nodes: np.ndarray, least: float, rounds: int = 20, damping: float = 0.85) -> np.ndarray:
    """Ranks of document ``k``'s ``nodes`` (places of its sentences), see ``ranks``.

    Equal sentences have equal ranks, so one of them stands for all. A graph above four blocks of these is made anew, block by block, in each round.
    """
    n = len(nodes)
    distinct, many = np.unique(nodes, return_counts=True)
    places, rows = m.graph(k)
    at = np.searchsorted(distinct, places)
    of, first = classes(rows, many[at])
    some, many, alike = taken(rows, first), many[at][first], np.bincount(of)

    def made() -> Iterator[np.ndarray]:
        for a, w in graph_rows(some):
            w = np.where(w >= least, np.round(w, 6), 0) * alike
            b = np.arange(a, a + len(w))
            w[b - a, b] = alike[b] - 1  # the others of its own class
            yield w

    parts = list(made()) if some.n <= 4 * BLOCK else None
    blocks = lambda: made() if parts is None else parts
    out = np.concatenate([w.sum(1) for w in blocks()]) if some.n else np.zeros(0)  # the graph is symmetric
    if not out.any():
        return np.full(n, 1 / n)
    share = np.divide(many, out, out=np.zeros(some.n), where=out > 0)
    r = np.full(some.n, 1 / n)
    for _ in range(rounds):
        sent = share * r
        r = (1 - damping) / n + damping * np.concatenate([w @ sent for w in blocks()])
    every = np.full(len(distinct), (1 - damping) / n)
    every[at] = r[of]
    return every[np.searchsorted(distinct, nodes)]


def ranks(docs: DataFrame, least: float, rounds: int = 20, damping: float = 0.85, key: str = "doc_id") -> DataFrame:
    """(key, i, rank) of every sentence: ``rounds`` rounds of PageRank over the cosines of at least ``least``, rounded to six digits; a document without such is uniform.

    Sentences of one place in texts that share a document's id are nodes of their own with the same edges.
    """

    def f(m: Weights) -> Iterator[tuple]:
        starts = np.flatnonzero(np.diff(m.all_doc, prepend=-1) != 0)
        ends = np.append(starts[1:], len(m.all_doc))
        found = [node_ranks(m, int(m.all_doc[a]), m.all_i[a:b], least, rounds, damping) for a, b in zip(starts, ends)]
        yield m.all_doc, m.all_i, np.concatenate(found) if found else np.zeros(0)

    return weighed(docs.where(F.col(key).isNotNull()), f, "i int, rank double", key)
