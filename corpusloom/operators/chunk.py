"""Ordered folds over one document: sections, chunkers, administrative line filter."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from hashlib import sha1

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.arrow import element_text, embed, embed_all
from corpusloom.operators.summarize import sentences

HEADING = re.compile(r"^(\d+(?:\.\d+)*)\.?\s+\S")


def line_kind(line: str) -> tuple[str, int | None]:
    """Kind and heading level of a line."""
    m = HEADING.match(line)
    kind = "bullet" if re.match(r"^[-*•]\s", line) else "heading" if m and len(line) < 90 else "paragraph"
    return kind, m[1].count(".") + 1 if kind == "heading" else None


def sections(text: str) -> list[dict]:
    """Each non-blank line with its kind, heading level and path of open headings."""
    path: list[str] = []
    out = []
    for i, line in enumerate(x.strip() for x in text.split("\n")):
        if not line:
            continue
        kind, level = line_kind(line)
        if level:
            path = [*path[: level - 1], line]
        out.append({"i": i, "kind": kind, "level": level, "path": list(path), "text": line})
    return out

def estimate(text: str) -> int:
    return max(1, int(len(re.findall(r"[\wÀ-ỹĐđ]+|[^\w\s]", text)) * 1.25))

def token_chunks(text: str, target: int = 420, overlap: int = 64, least: int = 8) -> list[dict]:
    """Whole sentences packed up to ``target`` estimated tokens; each chunk repeats the last sentences of the one before up to ``overlap``; repeated chunks dropped."""
    chunks: list[list[str]] = []
    held: list[str] = []
    sizes: list[int] = []
    size = 0
    for s in sentences(text):
        n = estimate(s)
        if held and size + n > target:
            chunks.append(held)
            at, size = len(held), 0
            while at and size + sizes[at - 1] <= overlap:
                at -= 1
                size += sizes[at]
            held, sizes = held[at:], sizes[at:]
        held.append(s)
        sizes.append(n)
        size += n
    if held and chunks and size < least:  # too little for a chunk of its own
        chunks[-1] = chunks[-1] + [s for s in held if s not in chunks[-1]]
    elif held:
        chunks.append(held)
    out, seen = [], set()
    for c in chunks:
        t = " ".join(c)
        if t.lower() not in seen:
            seen.add(t.lower())
            out.append({"index": len(out), "text": t, "tokens": estimate(t)})
    return out

def split_sentences(text: str) -> list[str]:
    return [s for s in re.split(r"(?<=[.!?])\s+|\n+", text.strip()) if s]


class ElementPacker:
    """Packs the elements of one document, given one by one, into chunks; of the document only the open chunk is held, and digests of those made.

    A chunk ends before an element that would pass its limit; before a heading, and where the next element turns away from the
    last (cosine of hashed vectors under ``turn``), once it has ``least`` tokens. Its limit is ``most`` tokens if it is empty or
    holds a heading, ``target`` and 120 (at most ``most``) if it holds a table, else ``target``. Paragraphs above ``most`` are parted
    at sentences. The next chunk repeats what ends the last one: whole elements, then whole sentences, about ``overlap`` tokens.
    Chunks that repeat an earlier text are dropped; ``made`` counts those, too.
    """

    def __init__(self, most: int = 640, target: int = 420, least: int = 120, overlap: int = 64, turn: float | None = None):
        self.most, self.target, self.least, self.overlap, self.turn = most, target, least, overlap, turn
        self.held: list[dict] = []
        self.made, self.seen, self.last = 0, set(), None

    def limit(self) -> int:
        kinds = {u["kind"] for u in self.held}
        if "table" in kinds:
            return min(self.most, self.target + 120)
        return self.most if not kinds or "heading" in kinds else max(self.least, self.target)

    def units(self, element: dict) -> list[dict]:
        """The element with its tokens, or its parts."""
        text = (element["text"] or "").strip()
        whole = element | {"text": text, "tokens": estimate(text)}
        if not text or element["kind"] != "paragraph" or whole["tokens"] <= self.most:
            return [whole] if text else []
        parts: list[list[str]] = []
        size = 0
        for s in split_sentences(text):
            n = estimate(s)
            if not parts or size + n > self.target:
                parts.append([])
                size = 0
            parts[-1].append(s)
            size += n
        return [element | {"text": " ".join(p), "tokens": estimate(" ".join(p))} for p in parts]

    def add(self, element: dict) -> list[dict]:
        """The chunks that end before this element or its parts."""
        return self.add_all([element])

    def add_all(self, elements: list[dict]) -> list[dict]:
        """As ``add`` of one after the other; their vectors are made together."""
        units = [u for e in elements for u in self.units(e)]
        return [c for u, turns in zip(units, self.turns([u["text"] for u in units])) for c in self.put(u, turns)]

    def put(self, u: dict, turns: bool) -> list[dict]:
        out, size = [], sum(x["tokens"] for x in self.held)
        ends = size + u["tokens"] > self.limit() or size >= self.least and (u["kind"] == "heading" or turns)
        if self.held and ends:
            out = self.close()
            self.held = self.repeated()
        self.held.append(u)
        return out

    def turns(self, texts: list[str]) -> list[bool]:
        """For each of the next texts whether it turns away from the one before it."""
        if self.turn is None or not texts:
            return [False] * len(texts)
        v = embed_all(texts, 64).astype(float)
        first = [] if self.last is not None else [False]
        near = cosines(v if self.last is None else np.concatenate([self.last[None], v]))
        self.last = v[-1]
        return first + (near < self.turn).tolist()

    def repeated(self) -> list[dict]:
        out: list[dict] = []
        left = self.overlap
        for u in reversed(self.held):
            if u["kind"] == "heading":  # goes along with what stands under it, at no cost
                out = [u, *out] if out else out
            elif left <= 0:
                break
            elif u["tokens"] <= left:
                out, left = [u, *out], left - u["tokens"]
            else:
                return [*self.tail(u, left), *out]
        return out

    @staticmethod
    def tail(u: dict, room: int) -> list[dict]:
        """The last sentences of an element: at least one unless it takes more than twice the room, more while they fit."""
        taken, size = [], 0
        for s in reversed(split_sentences(u["text"])):
            n = estimate(s)
            if size >= room or size + n > (room if taken else 2 * room):
                break
            taken.insert(0, s)
            size += n
        return [u | {"text": " ".join(taken), "tokens": estimate(" ".join(taken))}] if taken else []

    def close(self) -> list[dict]:
        """The open chunk, if there is one that was not there before."""
        if not self.held:
            return []
        h = self.held
        text = "\n\n".join(u["text"] if u["kind"] != "bullet" or u["text"][0] in "-*•" else f"- {u['text']}" for u in h)
        pages = [u["page"] for u in h if u.get("page")]
        path = next((u["path"] for u in reversed(h) if u.get("path")), [])
        key = sha1(" ".join(text.lower().split()).encode()).digest()
        self.made += 1
        if key in self.seen:
            return []
        self.seen.add(key)
        return [{"index": len(self.seen) - 1, "made": self.made - 1, "text": text, "tokens": estimate(text), "path": path, "elements": list(dict.fromkeys(u["i"] for u in h)), "kinds": list(dict.fromkeys(u["kind"] for u in h)), "page_start": min(pages, default=None), "page_end": max(pages, default=None)}]


def paragraph_chunks(text: str, size: int = 1200, overlap: int = 1) -> list[dict]:
    """Paragraphs packed to ``size`` characters; the last ``overlap`` paragraphs are repeated."""
    out: list[dict] = []
    held: list[str] = []
    for p in (x.strip() for x in re.split(r"\n+", text)):
        if not p:
            continue
        if held and sum(map(len, held)) + len(p) > size:
            out.append({"index": len(out), "text": "\n".join(held), "tokens": estimate("\n".join(held))})
            held = held[-overlap:] if overlap else []
        held = [*held, p]
    if held:
        out.append({"index": len(out), "text": "\n".join(held), "tokens": estimate("\n".join(held))})
    return out

def word_chunks(text: str, words: int = 490, most: int = 16) -> list[dict]:
    """Sentences packed to at most ``words`` words, the first ``most`` chunks."""
    out: list[list[str]] = []
    size = 0
    for s in sentences(text):
        n = len(s.split())
        if not out or size + n > words:
            out.append([])
            size = 0
        out[-1].append(s)
        size += n
    return [{"index": i, "text": " ".join(c), "tokens": estimate(" ".join(c))} for i, c in enumerate(out[:most])]

def goes_on(paragraph: str, line: str) -> bool:
    """Whether ``line`` goes on with a paragraph of five words or more that lacks a final stop; headings never do."""
    return len(paragraph.split()) >= 5 and not re.search(r"[.!?:;]$", paragraph) and not HEADING.match(line)


def merged_paragraphs(text: str) -> list[dict]:
    """Adjacent paragraphs joined while the growing one goes on, see goes_on."""
    out: list[str] = []
    for p in (x.strip() for x in text.split("\n")):
        if not p:
            continue
        if out and goes_on(out[-1], p):
            out[-1] += " " + p
        else:
            out.append(p)
    return [{"index": i, "text": x, "tokens": estimate(x)} for i, x in enumerate(out)]


def cosines(vectors: np.ndarray) -> np.ndarray:
    """Cosine of each row with the next."""
    n = np.linalg.norm(vectors, axis=1)
    return (vectors[:-1] * vectors[1:]).sum(1) / np.maximum(n[:-1] * n[1:], 1e-12)


def breakpoints(vectors: np.ndarray, how: str = "dynamic", fixed: float = 0.3, spread: float = 0.8, window: int = 3) -> list[int]:
    """Sentences at which a new chunk begins, by the distance (one less the cosine) of neighbours.

    "fixed": distance above ``fixed``; "dynamic": above the mean and ``spread`` standard deviations;
    "window": as dynamic, between the mean vectors of the ``window`` sentences before and from there.
    """
    n = len(vectors)
    if n < 2:
        return []
    if how == "window":
        sums = np.concatenate([np.zeros((1, vectors.shape[1])), np.cumsum(vectors, 0)])
        before = np.stack([(sums[i] - sums[max(0, i - window)]) / min(i, window) for i in range(1, n)])
        after = np.stack([(sums[min(n, i + window)] - sums[i]) / (min(n, i + window) - i) for i in range(1, n)])
        norm = np.linalg.norm(before, axis=1) * np.linalg.norm(after, axis=1)
        far = 1 - (before * after).sum(1) / np.maximum(norm, 1e-12)
    else:
        far = 1 - cosines(vectors)
    cut = fixed if how == "fixed" else far.mean() + spread * far.std()
    return (np.flatnonzero(far > cut) + 1).tolist()


def semantic_chunks(text: str, rule: str = "dynamic", most_chars: int = 1200, dim: int = 64, **options) -> list[dict]:
    """Sentences parted where their hashed vectors turn (see breakpoints) and before ``most_chars`` characters are passed."""
    s = sentences(text)
    if not s:
        return []
    starts = set(breakpoints(np.stack([embed(x, dim) for x in s]).astype(float), rule, **options))
    out: list[list[str]] = [[]]
    for i, x in enumerate(s):
        if out[-1] and (i in starts or sum(map(len, out[-1])) + len(out[-1]) + len(x) > most_chars):
            out.append([])
        out[-1].append(x)
    return [{"index": i, "text": " ".join(c), "tokens": estimate(" ".join(c))} for i, c in enumerate(out)]


CHUNKERS = {"token": token_chunks, "paragraph": paragraph_chunks, "words": word_chunks, "merge": merged_paragraphs, "semantic": semantic_chunks}

#: Documents whose chunks are held at once.
DOCUMENTS_HELD = 64


def chunked(batches: Iterator[pa.RecordBatch], f: Callable[[str], list]) -> Iterator[pa.RecordBatch]:
    """(id, index, text, tokens) of the chunks that ``f`` makes of (id, text); they leave after every ``DOCUMENTS_HELD`` documents, not after a whole batch."""
    for b in batches:
        for at in range(0, len(b), DOCUMENTS_HELD):
            part, row, found = b.slice(at, DOCUMENTS_HELD), [], []
            for i, text in enumerate(part.column(1)):
                for c in f(text.as_py() or ""):
                    row.append(i)
                    found.append((c["index"], c["text"], c["tokens"]) if isinstance(c, dict) else c)
            index, text, tokens = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row, pa.int64())), pa.array(index, pa.int32()), pa.array(text, pa.string()), pa.array(tokens, pa.int32())], names=["id", "index", "text", "tokens"])


def chunk(docs: DataFrame, how: str = "token", id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, index, text, tokens, chunk_id) by the named chunker."""
    f = CHUNKERS[how]
    kind = docs.schema[id_col].dataType.simpleString()
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    made = given.mapInArrow(lambda batches: chunked(batches, lambda x: f(x, **options)), f"id {kind}, index int, text string, tokens int").withColumnRenamed("id", id_col)
    key = F.concat_ws(":", F.col(id_col).cast("string"), F.col("index").cast("string"), F.substring("text", 1, 512))
    return made.withColumn("chunk_id", F.substring(F.sha1(key), 1, 20))

def build_sections(docs: DataFrame) -> DataFrame:
    """(doc_id, i, kind, level, path, text) of each line."""
    kind = "array<struct<i: int, kind: string, level: int, path: array<string>, text: string>>"
    udf = F.pandas_udf(lambda c: c.map(lambda x: sections(x or "")), kind)
    return docs.select("doc_id", F.explode(udf("text")).alias("s")).select("doc_id", "s.*")


def clean_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, i, text) of each line that is not blank, cleaned by its kind (see ``element_text``; bullets keep their symbols as tables do)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), DOCUMENTS_HELD):
                part, row, place, found = b.slice(at, DOCUMENTS_HELD), [], [], []
                for k, text in enumerate(part.column(1)):
                    for i, line in enumerate((text.as_py() or "").split("\n")):
                        if line := line.strip():
                            row.append(k)
                            place.append(i)
                            found.append(element_text(line, "table" if line_kind(line)[0] == "bullet" else "paragraph"))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row, pa.int64())), pa.array(place, pa.int32()), pa.array(found, pa.string())], names=["doc_id", "i", "text"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, i int, text string")
