"""Token counts with overlap resynchronisation.

Stable boundary: for a byte-level BPE whose pre-tokenizer is the usual pattern, with no normaliser
and no prefix space, a pre-token always ends between a non-space and a space, wherever encoding
began; what follows does not depend on what came before, and special strings hold no space. So
encodings of the two sides, spliced there, equal the encoding of the whole.

Huge documents (over ``chunk`` characters) are encoded in chunks. A chunk and a window around its
end overlap; both are encoded with offsets, and the splice goes to the stable boundary nearest the
chunk's end before and after which both encodings agree token by token. Where none is found the
overlap doubles, at last to the rest of the text. Memory is bounded by the chunk, not by the
document, unless the text has no stable boundary at all.

Other documents are cut at the same boundaries down to single words, whose counts a bounded cache
per Python worker holds; texts in which a cut is not proven (runs of spaces) and tokenizers of
another build are encoded whole.

Defined results: null and empty texts have 0 bytes and 0 tokens; bytes that are no UTF-8 are counted as
such and read as replacement characters, as the library takes only text; special strings in a text count
as the library does by default; rows that repeat each return a row; an empty table gives no rows.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import raw_texts

CHUNK = 1 << 15
OVERLAP = 512
CACHED = 600_000
UNPROVEN = -(1 << 40)


@cache
def load(path: str):
    """(encode(list of texts) -> list of id lists, Tokenizer or None, whether boundaries before spaces are proven)."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        with open(path) as f:
            conf = json.load(f)
        pre = conf.get("pre_tokenizer") or {}
        proven = conf.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not any(t["lstrip"] or t["rstrip"] or " " in t["content"] for t in conf.get("added_tokens", []))
        return lambda texts: [e.ids for e in tok.encode_batch_fast(texts, add_special_tokens=False)], tok, proven
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda texts: sp.encode(texts, num_threads=1), None, False


def stable(text: str, p: int) -> bool:
    return 0 < p < len(text) and text[p].isspace() and not text[p - 1].isspace()


def splice_point(text: str, start: int, end: int, overlap: int, left, window) -> int | None:
    """The stable boundary nearest ``end`` at which the chunk from ``start`` and the window agree; None if there is none."""
    base = max(start, end - overlap)
    a = {(start + x, start + y): i for i, (x, y) in zip(left.ids, left.offsets)}
    b = [((base + x, base + y), i) for i, (x, y) in zip(window.ids, window.offsets)]
    agreed = [a.get(span) == i for span, i in b]
    found = None
    for k in range(1, len(b)):
        p = b[k][0][0]
        if agreed[k - 1] and agreed[k] and b[k - 1][0][1] == p and stable(text, p) and (found is None or abs(p - end) < abs(found - end)):
            found = p
    return found


def encode_spliced(tok, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """Token ids of ``text``, encoded chunk by chunk."""
    ids: list[int] = []
    start = 0
    while len(text) - start > chunk:
        end, wide, p = start + chunk, overlap, None
        while p is None and end + wide < len(text):
            left = tok.encode(text[start : end + wide], add_special_tokens=False)
            window = tok.encode(text[max(start, end - wide) : end + wide], add_special_tokens=False)
            p = splice_point(text, start, end, wide, left, window)
            wide *= 2
        if p is None:
            break
        ids += [i for i, (_, y) in zip(left.ids, left.offsets) if start + y <= p]
        start = p
    return ids + tok.encode(text[start:], add_special_tokens=False).ids


class Counter:
    """Counts of a tokenizer's tokens, with word counts kept."""

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        self.encode, self.tok, self.proven = load(path)
        self.chunk, self.overlap = chunk, overlap
        self.words: dict[str, int] = {}

    def learn(self, words: set[str]) -> None:
        new = list(words - self.words.keys())
        if len(self.words) + len(new) > CACHED:
            self.words.clear()
            new = list(words)
        for w, ids in zip(new, self.encode([" " + w for w in new])):
            self.words[w] = len(ids) if w and not w[-1].isspace() else UNPROVEN

    def whole(self, texts: list[str]) -> list[int]:
        return [len(encode_spliced(self.tok, t, self.chunk, self.overlap)) if self.proven and len(t) > self.chunk else len(self.encode([t])[0]) for t in texts]

    def count(self, texts: list[str]) -> list[int]:
        if not self.proven:
            return self.whole(texts)
        split = [t.split(" ") if len(t) <= self.chunk else None for t in texts]
        words: set[str] = set()
        for s in split:
            if s:
                words.update(s[1:-1])
        self.learn(words)
        out, get = [], self.words.__getitem__
        ends = [x for s in split if s for x in ((s[0], " " + s[-1]) if len(s) > 1 else (s[0],))]
        edge = iter([len(i) for i in self.encode(ends)])
        for t, s in zip(texts, split):
            if s is None:
                out += self.whole([t])
                continue
            n = next(edge)
            if len(s) > 1:
                n += next(edge) + sum(map(get, s[1:-1]))
                if n < 0 or (s[0] and s[0][-1].isspace()):
                    n = self.whole([t])[0]
            out.append(n)
        return out


@cache
def counter(path: str, chunk: int, overlap: int) -> Counter:
    return Counter(path, chunk, overlap)


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", most: int = 1024, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of ``docs``; ``path``: the vocabulary file, at the same place on every machine."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path, chunk, overlap).count
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                raw = list(raw_texts(part.column(1)))
                n = count([x.decode("utf-8", "replace") for x in raw])
                yield pa.record_batch([part.column(0), pa.array(map(len, raw), pa.int64()), pa.array(n, pa.int64()), pa.array([x > most for x in n], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
