"""Quality classifier: an interpolated modified Kneser-Ney n-gram model of trusted text.

Symbols are the characters themselves, whatever the script; the order is ``ORDER``. Each task counts
the n-grams of the trusted texts it reads (pre-aggregated, one row per n-gram and task); counts,
continuation counts, discounts and back-off weights are DataFrame aggregations and joins sharded by
n-gram, over all trusted text. The model has a row for each n-gram seen, so it grows with the text.

A document's perplexity sums log p over its characters, from counts joined to the model:

* While the model has at most ``most_rows`` rows (16 bytes each), it is broadcast, and the join
  takes place where documents are read, by hashed lookup; texts are not shuffled.
* Beyond, each document's n-gram counts are joined to the sharded tables, order by order: what an
  order has not seen takes the context's back-off weight and goes on to the order below, merged
  with the other n-grams of that suffix. Both ways give the same perplexity (tested).

It is compared with the language's threshold: the ``quantile`` of the trusted documents' perplexities
in that language. Languages with under ``least_docs`` trusted documents (and null) take the quantile
over all languages.

Defined results: null and empty texts have infinite perplexity and are rejected. Repeated rows
are each scored, and count each when trusted. Where several labels meet one id, it is trusted if
any is. Without trusted text nothing but empty texts is rejected. All columns are carried through,
whatever their names. Characters that trusted text never holds share one unknown symbol's chance.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import Scratch, join_checked, raw_texts, stored

ORDER = 5
BLOCK = 1 << 18
START = "\n" * (ORDER - 1)
STEP, MIX, SALT = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def points(text: bytes) -> np.ndarray:
    """Code points of a text, after the start symbols."""
    return np.frombuffer((START + text.decode("utf-8", "replace")).encode("utf-32-le"), np.uint32)


def hashes(places: list[np.ndarray], most: int) -> list[np.ndarray]:
    """For k = 1 .. most: hashes of the last k characters; places: ORDER arrays, the last characters last."""
    total, power, out = np.zeros(len(places[0]), np.uint64), 1, []
    for k in range(1, most + 1):
        total = total + (places[ORDER - k].astype(np.uint64) + np.uint64(1)) * np.uint64(power)
        power = power * STEP % (1 << 64)
        x = total + np.uint64(k * SALT % (1 << 64))
        x ^= x >> np.uint64(31)
        x *= np.uint64(MIX)
        out.append(x ^ (x >> np.uint64(29)))
    return out


def gram_hashes(c: np.ndarray, most: int = ORDER) -> list[np.ndarray]:
    """For k = 1 .. most: hashes of the k characters that end at each place from ORDER - 1 on."""
    n = len(c) - (ORDER - 1)
    return hashes([c[i : i + n] for i in range(ORDER)], most)


def text_hash(grams: list[str]) -> np.ndarray:
    """The hashes that gram_hashes gives for these n-grams, which are of any order."""
    out = np.zeros(len(grams), np.uint64)
    size = np.fromiter(map(len, grams), np.int64, len(grams))
    for k in range(1, ORDER + 1):
        at = np.flatnonzero(size == k)
        c = np.frombuffer("".join(grams[i] for i in at.tolist()).encode("utf-32-le"), np.uint32).reshape(-1, k)
        padded = np.concatenate([np.zeros((len(at), ORDER - k), np.uint32), c], 1)
        out[at] = hashes([padded[:, i] for i in range(ORDER)], k)[k - 1]
    return out


def gram_counts(texts: DataFrame) -> DataFrame:
    """(gram string, n long): one row for each n-gram of ``ORDER`` characters and block of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def rows() -> pa.RecordBatch:
            c = np.concatenate(held)
            whole = np.concatenate([np.arange(s + ORDER - 1, s + len(x)) for s, x in zip(np.cumsum([0, *map(len, held[:-1])]), held)])
            h = gram_hashes(c)[ORDER - 1][whole - (ORDER - 1)]
            _, first, n = np.unique(h, return_index=True, return_counts=True)
            at = whole[first][:, None] + np.arange(1 - ORDER, 1)
            joined = c[at].astype("<u4").tobytes().decode("utf-32-le")
            return pa.record_batch([pa.array([joined[i : i + ORDER] for i in range(0, len(joined), ORDER)], pa.string()), pa.array(n.astype(np.int64))], names=["gram", "n"])

        for b in batches:
            for t in raw_texts(b.column(0)):
                c = points(t)
                if len(c) >= ORDER:
                    held.append(c)
                    size += len(c)
                if size > 16 * BLOCK:
                    yield rows()
                    held, size = [], 0
        if held:
            yield rows()

    return texts.mapInArrow(run, "gram string, n long")


def discounts(spread: dict[int, int]) -> list[float]:
    """D1, D2, D3+ from the numbers of n-grams seen once to four times; 0.5, 1, 1.5 where those are missing."""
    n1, n2, n3, n4 = (spread.get(i, 0) for i in (1, 2, 3, 4))
    if not (n1 and n2 and n3 and n4):
        return [0.5, 1.0, 1.5]
    y = n1 / (n1 + 2 * n2)
    return [max(0.05, i - (i + 1) * y * b / a) for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]


def model(counts: DataFrame, scratch: Scratch) -> tuple[DataFrame, float]:
    """((gram, logp, gamma) of all n-grams of 1 .. ORDER characters that were seen, as n-grams or as contexts; log p of an unknown character).

    gamma is the log of the back-off weight of the n-gram as a context (0 where it was none). Joins
    and aggregations are sharded by n-gram and by context.
    """
    tables = {ORDER: scratch.stored(counts.groupBy("gram").agg(F.sum("n").alias("n")), "grams")}
    for k in range(ORDER - 1, 0, -1):  # continuation counts: in how many contexts it was seen
        tables[k] = tables[k + 1].groupBy(F.substring("gram", 2, k).alias("gram")).agg(F.count("*").alias("n"))
    found = reduce(DataFrame.union, [t.where("n <= 4").groupBy("n").agg(F.count("*").alias("m")).select(F.lit(k).alias("k"), "n", "m") for k, t in tables.items()]).collect()  # at most 4 * ORDER rows
    symbols = tables[1].count() + 1
    rows, gammas, lower, unknown = [], [], None, 0.0
    for k in range(1, ORDER + 1):
        d = discounts({r.n: r.m for r in found if r.k == k})
        cut = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        t = tables[k].withColumn("context", F.substring("gram", 1, k - 1) if k > 1 else F.lit(""))
        c = t.groupBy("context").agg(F.sum("n").alias("total"), F.sum(cut).alias("cut")).select("context", "total", (F.col("cut") / F.col("total")).alias("weight"))
        if k == 1:
            first = c.first()  # the one empty context
            total, weight = (first.total, first.weight) if first else (1, 1.0)
            unknown = float(np.log(weight / symbols)) if first else float(-np.log(symbols + 1))
            p = t.select("gram", (F.greatest(F.lit(0.0), F.col("n") - cut) / F.lit(float(total)) + F.lit(weight / symbols)).alias("p"))
        else:
            p = t.join(c, "context").select("gram", (F.greatest(F.lit(0.0), F.col("n") - cut) / F.col("total")).alias("own"), "weight")
            low = lower.select(F.col("gram").alias("suffix"), F.col("p").alias("below"))
            p = p.join(low, F.substring("gram", 2, k - 1) == F.col("suffix")).select("gram", (F.col("own") + F.col("weight") * F.col("below")).alias("p"))
            gammas.append(c.select(F.col("context").alias("gram"), F.log("weight").alias("gamma")))
        lower = scratch.stored(p, "probabilities")
        rows.append(lower.select("gram", F.log("p").alias("logp")))
    gamma = reduce(DataFrame.union, gammas).withColumnRenamed("gram", "g")
    every = reduce(DataFrame.union, rows).join(gamma, F.col("gram") == F.col("g"), "full")
    return scratch.stored(every.select(F.coalesce("gram", "g").alias("gram"), "logp", F.coalesce("gamma", F.lit(0.0)).alias("gamma")), "model"), unknown


class Lookup:
    """Hashed n-grams in memory: where each lies among the sorted hashes, by the hash's first bits."""

    def __init__(self, hashes: np.ndarray, logp: np.ndarray, gamma: np.ndarray):
        order = np.argsort(hashes)
        self.keys = np.append(hashes[order], np.uint64(0xFFFFFFFFFFFFFFFF))
        self.logp, self.gamma = np.append(logp[order], np.nan).astype(np.float32), np.append(gamma[order], 0).astype(np.float32)
        self.bits = np.uint64(64 - max(8, int(np.ceil(np.log2(4 * len(hashes) + 1)))))
        self.start = np.searchsorted(self.keys[:-1] >> self.bits, np.arange((1 << int(64 - self.bits)) + 1, dtype=np.uint64)).astype(np.int32)
        self.longest = int(np.diff(self.start).max(initial=0))

    def at(self, h: np.ndarray) -> np.ndarray:
        """Places of the hashes; the last place for those that are missing."""
        i = self.start[(h >> self.bits).astype(np.int64)]
        out = np.where(self.keys[i] == h, i, len(self.keys) - 1)
        open_ = np.flatnonzero(self.keys[i] < h)
        for _ in range(self.longest - 1):
            if not len(open_):
                break
            i[open_] += 1
            k = self.keys[i[open_]]
            hit = k == h[open_]
            out[open_[hit]] = i[open_[hit]]
            open_ = open_[k < h[open_]]
        return out


def log_likelihood(look: Lookup, unknown: float, c: np.ndarray) -> float:
    """Sum of log p of the characters of ``c`` from place ORDER - 1 on."""
    h = gram_hashes(c)
    total = 0.0
    left = np.arange(len(h[0]))
    before = [x[:-1] for x in gram_hashes(np.concatenate([np.zeros(1, c.dtype), c]), ORDER - 1)]  # contexts: what ends one place earlier
    for k in range(ORDER, 0, -1):
        at = look.at(h[k - 1][left])
        p = look.logp[at]
        seen = ~np.isnan(p)
        total += float(p[seen].sum(dtype=np.float64))
        left = left[~seen]
        if not len(left):
            return total
        total += float(look.gamma[look.at(before[k - 2][left])].sum(dtype=np.float64)) if k > 1 else unknown * len(left)
    return total


def with_sums_by_lookup(docs: DataFrame, at: int, table: DataFrame, unknown: float) -> DataFrame:
    """``docs`` with the columns ll (log-likelihood) and size (characters) added; the model is broadcast."""
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = text_hash(b.column(0).to_pylist()).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h), b.column(1), b.column(2)], names=["h", "logp", "gamma"])

    numbers = table.select("gram", F.coalesce("logp", F.lit(float("nan"))).cast("float").alias("logp"), F.col("gamma").cast("float").alias("gamma"))
    rows = numbers.mapInArrow(hashed, "h long, logp float, gamma float").toArrow()  # 16 bytes for each of at most most_rows rows, see with_perplexity
    held = docs.sparkSession.sparkContext.broadcast((rows["h"].to_numpy().view(np.uint64), rows["logp"].to_numpy(), rows["gamma"].to_numpy(), unknown))
    del rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = Lookup(*held.value[:3])
        for b in batches:
            ll, size = [], []
            for t in raw_texts(b.column(at)):
                c = points(t)
                n = len(c) - (ORDER - 1)
                ll.append(sum(log_likelihood(look, held.value[3], c[i : i + BLOCK + ORDER - 1]) for i in range(0, n, BLOCK)))
                size.append(n)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ll, pa.float64()), pa.array(size, pa.int64())], names=[*b.schema.names, "ll", "size"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("ll", T.DoubleType()), T.StructField("size", T.LongType())]))


def with_sums_by_joins(docs: DataFrame, at: int, table: DataFrame, unknown: float, scratch: Scratch) -> DataFrame:
    """As with_sums_by_lookup, by joins of each text's n-gram counts to the sharded model; equal texts are scored once."""
    text = F.col(docs.columns[at])
    digest = F.sha2(F.coalesce(text, F.lit("")), 256)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            who, grams, n = [], [], []
            for i, t in enumerate(raw_texts(b.column(1))):
                s = START + t.decode("utf-8", "replace")
                own: dict[str, int] = {}
                for k in range(len(s) - ORDER + 1):
                    own[s[k : k + ORDER]] = own.get(s[k : k + ORDER], 0) + 1
                who += [i] * len(own)
                grams += own
                n += own.values()
            yield pa.record_batch([b.column(0).take(pa.array(who, pa.int64())), pa.array(grams, pa.string()), pa.array(n, pa.int64())], names=["digest", "gram", "n"])

    counts = docs.select(digest.alias("digest"), F.coalesce(text, F.lit("")).alias("t")).dropDuplicates(["digest"]).mapInArrow(run, "digest string, gram string, n long")
    parts, model_rows = [], table.toDF("g", "logp", "gamma")
    for k in range(ORDER, 0, -1):
        joined = scratch.stored(counts.join(model_rows.where("logp IS NOT NULL").select("g", "logp"), F.col("gram") == F.col("g"), "left").select("digest", "gram", "n", "logp"), f"order{k}")
        parts.append(joined.where("logp IS NOT NULL").groupBy("digest").agg(F.sum(F.col("n") * F.col("logp")).alias("ll"), F.sum("n").alias("size")))
        rest = joined.where("logp IS NULL").select("digest", "gram", "n")
        if k == 1:
            parts.append(rest.groupBy("digest").agg((F.sum("n") * unknown).alias("ll"), F.sum("n").alias("size")))
        else:
            contexts = rest.groupBy("digest", F.substring("gram", 1, k - 1).alias("context")).agg(F.sum("n").alias("n"))
            parts.append(contexts.join(model_rows, F.col("context") == F.col("g")).groupBy("digest").agg(F.sum(F.col("n") * F.col("gamma")).alias("ll"), F.lit(0).cast("long").alias("size")))
            counts = rest.groupBy("digest", F.substring("gram", 2, k - 1).alias("gram")).agg(F.sum("n").alias("n"))
    sums = scratch.stored(reduce(DataFrame.union, parts).groupBy(F.col("digest").alias("own")).agg(F.sum("ll").alias("ll"), F.sum("size").alias("size")), "sums")
    return docs.join(sums, digest == F.col("own"), "left").select(*docs.columns, F.coalesce("ll", F.lit(0.0)).alias("ll"), F.coalesce("size", F.lit(0)).alias("size"))


def with_perplexity(docs: DataFrame, trained: tuple[DataFrame, float], scratch: Scratch, text_col: str = "text", out: str = "perplexity", most_rows: int = 2_000_000) -> DataFrame:
    """``docs`` and its perplexity in the column ``out``; the model is broadcast if it has at most ``most_rows`` rows."""
    table, unknown = trained
    cols = docs.columns
    at = cols.index(text_col)
    plain = docs.toDF(*[f"c{i}" for i in range(len(cols))])
    small = table.limit(most_rows + 1).count() <= most_rows
    summed = with_sums_by_lookup(plain, at, table, unknown) if small else with_sums_by_joins(plain, at, table, unknown, scratch)
    ppl = F.when(F.col("size") > 0, F.exp(-F.col("ll") / F.col("size"))).otherwise(F.lit(float("inf")))
    return summed.select(*plain.columns, ppl.alias("ppl")).toDF(*cols, out)


def thresholds(scored: DataFrame, lang: str, ppl: str, quantile: float, least_docs: int = 30) -> DataFrame:
    """(t_lang, t_cut): the quantile of each language and, under a null language, the one over all."""
    q = F.percentile_approx(ppl, F.lit(quantile), 100_000)
    finite = scored.where(F.col(ppl) < float("inf"))
    by = finite.where(F.col(lang).isNotNull()).groupBy(F.col(lang).alias("t_lang")).agg(q.alias("t_cut"), F.count("*").alias("n")).where(F.col("n") >= least_docs).select("t_lang", "t_cut")
    return by.union(finite.agg(q.alias("q")).select(F.lit(None).cast("string"), "q"))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """(trusted_id): the documents that a label calls good."""
    return labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("trusted_id")).distinct()


def train(texts: DataFrame, scratch: Scratch) -> tuple[DataFrame, float]:
    """The model of the single text column of ``texts``."""
    return model(scratch.stored(gram_counts(texts), "gramcounts"), scratch)


def classify(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = 0.996, most_rows: int = 2_000_000) -> tuple[DataFrame, list[str]]:
    """``docs`` with three columns added, named in the list: perplexity, threshold, keep."""
    names = []
    for n in ("perplexity", "threshold", "keep"):
        while n in docs.columns:
            n = f"{n}_"
        names.append(n)
    scratch, cols = Scratch(docs.sparkSession), docs.columns
    sure = join_checked(docs.select(F.col(id_col).alias("d"), F.col(lang_col).cast("string").alias("l"), F.col(text_col).cast("string").alias("t")), stored(trusted, "trusted"), F.col("d") == F.col("trusted_id"), "left_semi")
    trained = train(sure.select("t"), scratch)
    cuts = stored(thresholds(with_perplexity(sure.select("l", "t"), trained, scratch, "t", "p", most_rows).select("l", "p"), "l", "p", quantile), "thresholds")
    every = cuts.where(F.col("t_lang").isNull()).agg(F.max("t_cut")).first()[0]
    scored = with_perplexity(docs, trained, scratch, text_col, names[0], most_rows)
    plain = scored.toDF(*[f"c{i}" for i in range(len(cols))], "ppl")
    out = join_checked(plain, cuts.where(F.col("t_lang").isNotNull()), F.col(f"c{cols.index(lang_col)}").cast("string") == F.col("t_lang"), "left")
    cut = F.coalesce(F.col("t_cut"), F.lit(every), F.lit(float("inf"))).cast("double")
    keep = (F.col("ppl") <= F.col("cut")) & (F.col("ppl") < float("inf"))
    return out.withColumn("cut", cut).select(*plain.columns, "cut", keep.alias("keep")).toDF(*cols, *names), names
