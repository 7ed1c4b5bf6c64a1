"""Language-model scores: the marginal probability of a text over its subword segmentations, learnt by counting.

Each word's lattice holds the pieces of a public vocabulary (``lattice.py``) and, as further arcs, the whole words
of the training texts with their discounted relative frequencies; the forward recursion in log space sums all
segmentations. A word without a count is thus scored by its pieces alone, and the model is a distribution over all
texts. The vocabulary's scores weigh the pieces first; they are then re-estimated on the training words by expected
counts over the lattices. Languages are components of a mixture, each with its own word counts and piece scores; a
text's language is not looked at when it is scored, but summed out.

Scale: texts are read twice, to count words and to score. Counts leave a task pre-aggregated; counts, discounts and
every round of expected counts are aggregations over the distinct words, and a lattice is walked once a distinct
word, not once an occurrence. Scores of the most frequent words, at most ``HEAD`` of at most ``WIDE`` bytes, are
broadcast and summed where a text is read; only its rarer words are shuffled, as (row, word, count), and joined to
theirs, so no hot word burdens a task. What reaches the driver has the size of the vocabulary times the components,
or of the head, whatever the corpus.

The public vocabularies hold no unigram probabilities; scores that are ranks are read by Zipf's law, then learnt.
Defined results: null texts are empty (one token, the end); repeated rows count and return each; a null id is
neither held out nor learnt from; null languages are one more; without training texts the pieces' prior alone
scores; an empty table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import lattice
from corpusloom.llm.common import Scratch, raw_texts

LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))
#: The end of a text; words are never empty.
END = b""
#: Bounds of what is broadcast: words, and bytes of each.
HEAD, WIDE = 1 << 17, 64
#: Distinct words that a task holds before it hands them on.
HELD = 200_000


def words_of(raw: bytes) -> Counter:
    """How often each word of a text occurs, and its end."""
    c = Counter(raw.translate(LOWER).split())  # of bytes: space and 9 to 13
    c[END] = 1
    return c


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, part, n) of ``texts`` (part, text), summed as far as a task holds them; null parts are not learnt and count 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int | None, Counter] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for part, c in held.items():
                words, n = list(c), list(c.values())
                for i in range(0, len(words), 1 << 16):
                    s = slice(i, i + (1 << 16))
                    yield pa.record_batch([pa.array(words[s], pa.binary()), pa.array([part] * len(words[s]), pa.int32()), pa.array([0] * len(words[s]) if part is None else n[s], pa.int64())], names=["word", "part", "n"])
            held.clear()

        for b in batches:
            for part, raw in zip(b.column(0).to_pylist(), raw_texts(b.column(1))):
                held.setdefault(part, Counter()).update(words_of(raw))
                if sum(map(len, held.values())) > HELD:
                    yield from out()
        yield from out()

    return texts.mapInArrow(run, "word binary, part int, n long")


class Model:
    """The shares of components in the training texts, their words, distinct words and discounts, and the piece scores of each."""

    def __init__(self, texts: list[int], stats: list[tuple[int, int, int, int]], prior: np.ndarray):
        """``stats``: words, distinct words, words seen once and words seen twice of each component."""
        self.share = np.array(texts) / max(1, sum(texts))
        self.n, self.v, once, twice = np.array(stats, float).T
        self.discount = (once + 0.5) / (once + 2 * twice + 1)
        self.scores = np.tile(prior, (len(texts), 1))

    def word_scores(self, vocabulary: lattice.Vocabulary, words: list[bytes], counts: np.ndarray) -> np.ndarray:
        """[component, word]: log10 of a word's probability, given its ``counts`` of the same shape."""
        pieces = lattice.log_likelihood(vocabulary, self.scores, words) / np.log(10)
        n, d = np.maximum(self.n, 1)[:, None], self.discount[:, None]
        with np.errstate(divide="ignore"):
            seen = np.log10(np.maximum(counts - d, 0) / n)
            left = np.where(self.n > 0, np.log10(self.discount * self.v / n[:, 0]), 0.0)[:, None]
        return np.logaddexp2(seen * np.log2(10), (left + pieces) * np.log2(10)) / np.log2(10)


def _learn(counts: DataFrame, model: Model, path: str, rounds: int) -> None:
    """Re-estimate the piece scores of each component on its distinct words."""
    context, vocabulary = counts.sparkSession.sparkContext, lattice.load(path)
    many, size = model.scores.shape
    for _ in range(rounds):
        held = context.broadcast(model.scores)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            v, total = lattice.load(path), np.zeros((many, size))
            for b in batches:
                words = np.array(b.column(0).to_pylist() + [None], object)[:-1]
                for k in range(many):
                    total[k] += lattice.expected_counts(v, held.value[k], list(words[b.column(1 + k).to_numpy() > 0]))
            k, piece = np.nonzero(total)
            yield pa.record_batch([pa.array(k, pa.int32()), pa.array(piece, pa.int32()), pa.array(total[k, piece])], names=["k", "piece", "n"])

        found = counts.mapInArrow(run, "k int, piece int, n double").groupBy("k", "piece").agg(F.sum("n").alias("n")).toArrow()
        total = np.zeros((many, size))
        total[found["k"].to_numpy(), found["piece"].to_numpy()] = found["n"].to_numpy()
        model.scores = np.stack([vocabulary.learnt(x) for x in total])
        held.destroy()


def _head(words: DataFrame, known: list[str]) -> tuple[dict[bytes, int], np.ndarray]:
    """Places of the most frequent words and their scores; whole counts of equal eighths of a power of two, as many as fit."""
    level = F.floor(F.log2("c") * 8).cast("int")
    short = words.where((F.col("c") > 0) & (F.octet_length("of") <= WIDE)).withColumn("level", level)
    cut, held = None, 0
    for r in short.groupBy("level").count().orderBy(F.desc("level")).collect():  # at most 8 * 63 rows
        held += r["count"]
        if held > HEAD:
            break
        cut = r["level"]
    if cut is None:
        return {}, np.zeros((0, len(known)))
    found = short.where(F.col("level") >= cut).select("of", *known).toArrow()
    return {w: i for i, w in enumerate(found["of"].to_pylist())}, np.stack([found[k].to_numpy() for k in known], 1).astype(float)


def score(docs: DataFrame, path: str, rounds: int = 2, most_components: int = 8) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of ``docs`` (doc_id, lang, text).

    ``path``: a sentencepiece model, at the same place on every machine. ``most_components``: that many languages
    with the most training texts have a component of their own, all others share one.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")
    texts = docs.select("doc_id", lang.alias("lang"), F.coalesce(rest == 0, F.lit(False)).alias("held_out"), F.coalesce(rest != 0, F.lit(False)).alias("learn"), F.col("text").cast("string").alias("text"))
    shares = texts.where("learn").groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang")
    langs = shares.limit(most_components).collect()
    others = texts.where("learn").count() - sum(r.n for r in langs)
    part = F.coalesce(*[F.when(F.col("lang") == r.lang, k) for k, r in enumerate(langs)], F.lit(len(langs)))
    share = [*(r.n for r in langs), *([others] if others or not langs else [])]
    columns = [f"c{k}" for k in range(len(share))]

    seen = word_counts(texts.select(F.when(F.col("learn"), part).alias("part"), "text"))
    counts = scratch.stored(seen.groupBy("word").agg(*[F.coalesce(F.sum(F.when(F.col("part") == k, F.col("n"))), F.lit(0)).alias(c) for k, c in enumerate(columns)]), "counts")
    number = lambda x: F.sum(x.cast("long"))
    total = sum((F.col(c) for c in columns), F.lit(0))
    wanted = [x for c in columns for x in (F.sum(c), number(F.col(c) > 0), number(F.col(c) == 1), number(F.col(c) == 2))]
    *found, n_all, v_all = (x or 0 for x in counts.agg(*wanted, F.sum(total), number(total > 0)).first())
    model = Model(share, [tuple(found[i : i + 4]) for i in range(0, len(found), 4)], lattice.load(path).prior)
    if n_all:
        _learn(counts, model, path, rounds)
    held = spark.sparkContext.broadcast(model)
    parts = [f"s{k}" for k in range(len(share))]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = lattice.load(path)
        for b in batches:
            known = np.stack([b.column(1 + k).to_numpy() for k in range(len(parts))])
            made = held.value.word_scores(v, b.column(0).to_pylist(), known)
            c = known.sum(0)
            base = np.log10((c + 0.1) / (n_all + 0.1 * (v_all + 1)))
            yield pa.record_batch([b.column(0), pa.array(c), pa.array(base), *[pa.array(x) for x in made]], names=["of", "c", "base", *parts])

    words = scratch.stored(counts.mapInArrow(walk, "of binary, c long, base double, " + ", ".join(f"{k} double" for k in parts)), "words")
    held.destroy()
    scratch.drop(counts)
    head = spark.sparkContext.broadcast(_head(words, ["base", *parts]))
    sums = ["base", *parts]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, value = head.value
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                b = whole.slice(at, 64)
                rows, tail, known, total_, held_ = [], [], [], [], np.zeros((b.num_rows, len(sums)))
                for i, raw in enumerate(raw_texts(b.column(3))):
                    c = words_of(raw)
                    at_, n = [], []
                    for w, k in c.items():
                        x = place.get(w)
                        if x is None:
                            rows.append(i)
                            tail.append((w, k))
                        else:
                            at_.append(x)
                            n.append(k)
                    held_[i] = np.array(n, float) @ value[at_]
                    known.append(sum(n))
                    total_.append(sum(c.values()))
                ids = b.column(0).to_numpy()
                none = pa.nulls(b.num_rows, pa.int64())
                own = [b" " + int(r).to_bytes(8, "big") for r in ids]  # no word holds a space, so it meets none, and rows spread
                yield pa.record_batch([b.column(0), b.column(1), b.column(2), pa.array(own, pa.binary()), none, pa.array(total_, pa.int64()), pa.array(known, pa.int64()), *[pa.array(x) for x in held_.T]], names=names)
                for i in range(0, len(rows), 1 << 16):
                    s = slice(i, i + (1 << 16))
                    m = len(rows[s])
                    empty = [pa.nulls(m, pa.int64())] * 2 + [pa.nulls(m, pa.float64())] * len(sums)
                    yield pa.record_batch([pa.array(ids[rows[s]]), pa.nulls(m, b.column(1).type), pa.nulls(m, pa.bool_()), pa.array([w for w, _ in tail[s]], pa.binary()), pa.array([k for _, k in tail[s]], pa.int64()), *empty], names=names)

    given = texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", "text")
    names = ["row", "doc_id", "held_out", "word", "n", "n_tokens", "n_known", *[f"h_{k}" for k in sums]]
    schema = f"row long, doc_id {given.schema['doc_id'].dataType.simpleString()}, held_out boolean, word binary, n long, n_tokens long, n_known long, " + ", ".join(f"h_{k} double" for k in sums)
    joined = given.mapInArrow(add, schema).join(words, F.col("word") == F.col("of"), "left")
    zero = lambda x: F.coalesce(x, F.lit(0))
    both = [F.sum(zero(F.col(f"h_{k}")) + zero(F.col("n") * F.col(k))).alias(k) for k in sums]
    known = F.sum(zero(F.col("n_known")) + F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("n_known")
    of = joined.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.sum("n_tokens").alias("n_tokens"), known, *both)
    logs = [F.col(k) + F.lit(float(np.log10(x))) for k, x in zip(parts, model.share) if x > 0] or [F.col("s0")]
    top = F.greatest(*logs) if len(logs) > 1 else logs[0]
    marginal = top + F.log10(sum((F.pow(F.lit(10.0), x - top) for x in logs), F.lit(0.0)))
    return of.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), marginal.alias("score"))
