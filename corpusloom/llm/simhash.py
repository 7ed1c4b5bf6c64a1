"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most 2r bits share a variant within r bits of both, so every
fingerprint emits its whole ball of radius r (r = 2 over 64 bits: 2,081 variants) and those that
meet on a variant are linked. Meeting proves the distance by the triangle inequality; where
fingerprints collide on a variant, each is compared with the first all the same, and only those
within 2r bits are linked.

Scale: balls are shuffled as tries. The shuffle key is a variant's first ``prefix_bits`` bits, so
a fingerprint travels once for each prefix that its ball reaches (79 rows at 12 bits) and not once
for each variant; the prefix and the number of partitions grow with the fingerprints, so that a
partition holds about ``ROWS_EACH`` rows whatever their number; the rest of the ball unfolds bit group by bit group in the reducer, where a
branch that only one fingerprint reaches is cut, as nothing can meet there. Equal fingerprints are
merged before. Within a reducer, fingerprints that meet are joined by union-find and only one
link per fingerprint and reducer leaves it, never all pairs of a group; ``components`` finishes.
A reducer unfolds at most about ``most_rows`` branches at a time, split at key borders.

Defined results: null and empty texts, and texts without words, have fingerprint zero, which
links like any other. Fewer than four words: the whole sequence is the one shingle. Repeated rows
(equal ids) each return a row; null ids take part but never become a component's id unless it
holds nothing else (then null). Empty tables give no rows. Text may be of any length: shingles
are hashed in slices, so memory beyond the text itself is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import Scratch, components, raw_texts

SEED = 42
SLICE = 1 << 16
ROWS_EACH = 1_500_000
#: For each byte, eight 8-bit lanes of one uint64 that hold its bits.
LANES = np.array([sum(((b >> i) & 1) << (8 * i) for i in range(8)) for b in range(256)], np.uint64)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the 64-bit ``hashes`` set each bit, from bit 0 on."""
    out = np.zeros((8, 8), np.int64)
    held = np.ascontiguousarray(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    for i in range(0, len(held), 255):  # a lane holds up to 255
        lanes = LANES[held[i : i + 255]].sum(axis=0, dtype=np.uint64)
        out += np.ascontiguousarray(lanes, "<u8").view(np.uint8).reshape(8, 8)
    return out.reshape(64)


def fingerprint(text: bytes, words_a_shingle: int = 4) -> int:
    """SimHash of the ASCII-lower-cased text over word shingles, repeats included."""
    words = text.lower().split()  # for bytes: A-Z only, and ASCII white space
    if not words:
        return 0
    k = min(words_a_shingle, len(words))
    n = len(words) - k + 1
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[:n].tolist()
    stops = ends[k - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for i in range(0, n, SLICE):
        counts += bit_counts(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[i : i + SLICE], stops[i : i + SLICE])), np.uint64, min(SLICE, n - i)))
    return int(((2 * counts > n).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_a_shingle: int = 4) -> DataFrame:
    """(doc_id, fp long): the unsigned fingerprint in a long's bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, words_a_shingle) for t in raw_texts(b.column(1))], np.uint64)
            yield pa.record_batch([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, fp long")


@cache
def patterns(bits: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Masks of up to ``most`` set bits out of ``bits``, and their number of set bits."""
    found = [(sum(1 << b for b in c), r) for r in range(most + 1) for c in combinations(range(bits), r)]
    return np.array([m for m, _ in found], np.uint64), np.array([r for _, r in found], np.int8)


def _meet(fps: np.ndarray, variant: np.ndarray, who: np.ndarray, left: np.ndarray, depth: int, most_rows: int, step: int = 4) -> np.ndarray:
    """Root (an index into ``fps``) of each fingerprint among those that share a whole variant.

    variant: the ball's branch, settled in its first ``depth`` bits and like the fingerprint in
    the others; left: flips that remain.
    """
    root = np.arange(len(fps))

    def find(x: np.ndarray) -> np.ndarray:
        while True:
            up = root[x]
            if (up == x).all():
                return x
            x = up

    stack = [(variant, who, left, depth)]
    while stack:
        variant, who, left, depth = stack.pop()
        key = variant >> np.uint64(64 - depth) if depth < 64 else variant
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
        group = np.cumsum(new) - 1
        size = np.bincount(group) if len(key) else np.zeros(0, np.int64)
        keep = size[group] > 1
        order, group = order[keep], group[keep]
        if not len(order):
            continue
        variant, who, left = variant[order], who[order], left[order]
        if depth == 64:
            lead = who[np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))]
            near = np.bitwise_count(fps[who] ^ fps[lead[np.unique(group, return_inverse=True)[1]]]) <= 4
            who, group = who[near], group[near]
            first = np.concatenate([[True], group[1:] != group[:-1]])
            starts = np.flatnonzero(first)
            nth = np.cumsum(first) - 1
            while True:  # union: every member and its root take the group's smallest root
                r = find(who)
                low = np.minimum.reduceat(r, starts)[nth]
                if (low == r).all():
                    break
                np.minimum.at(root, r, low)
            continue
        bits = min(step, 64 - depth)
        cuts = [0]
        if len(order) > most_rows:  # several passes, split where the key changes
            ends = np.flatnonzero(np.concatenate([group[1:] != group[:-1], [True]])) + 1
            for e in ends:
                if e - cuts[-1] >= most_rows:
                    cuts.append(int(e))
        if cuts[-1] != len(order):
            cuts.append(len(order))
        for a, b in zip(cuts[:-1], cuts[1:]):
            parts = []
            for flips in range(3):
                at = np.flatnonzero(left[a:b] == flips) + a
                if len(at):
                    masks, used = patterns(bits, min(flips, bits))
                    masks = masks << np.uint64(64 - depth - bits)
                    parts.append(((variant[at][:, None] ^ masks).ravel(), np.repeat(who[at], len(masks)), (flips - used[None, :]).repeat(len(at), axis=0).ravel().astype(np.int8)))
            stack.append((*(np.concatenate(x) for x in zip(*parts)), depth + bits))
    return find(np.arange(len(fps)))


def dealing(n: int, rows_each: int = ROWS_EACH) -> tuple[int, int]:
    """(prefix bits, partitions) for n fingerprints: about ``rows_each`` rows a partition, and 16 prefixes or more for each."""
    bits = 12
    while True:
        parts = -(-n * (1 + bits + bits * (bits - 1) // 2) // rows_each)
        if 16 * parts <= 1 << bits or bits >= 30:
            return bits, max(1, parts)
        bits += 2


def links(fps: DataFrame, most_rows: int = 400_000, rows_each: int = ROWS_EACH) -> DataFrame:
    """(a, b): for each reducer, links that join the fingerprints that meet there; ``fps`` (a stored table) has distinct fp."""
    prefix_bits, parts = dealing(fps.count(), rows_each)
    masks, used = patterns(prefix_bits, 2)
    plan = F.array(*[F.struct(F.lit(int(np.uint64(int(m) << (64 - prefix_bits)).astype(np.int64))).alias("m"), F.lit(int(2 - u)).cast("byte").alias("left")) for m, u in zip(masks, used)])
    rows = fps.select("fp", F.explode(plan).alias("x")).select("fp", F.col("fp").bitwiseXOR(F.col("x.m")).alias("variant"), "x.left")
    prefix = F.shiftrightunsigned("variant", 64 - prefix_bits)
    usual = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, prefix) if parts > usual else rows.repartition(prefix)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy()) for b in batches if b.num_rows]
        if not got:
            return
        fp, variant, left = (np.concatenate(x) for x in zip(*got))
        own, who = np.unique(fp, return_inverse=True)
        root = _meet(own.view(np.uint64), variant.view(np.uint64), who.astype(np.int64), left, prefix_bits, most_rows)
        at = np.flatnonzero(root != np.arange(len(own)))
        yield pa.record_batch([pa.array(own[root[at]]), pa.array(own[at])], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_a_shingle: int = 4) -> DataFrame:
    """(doc_id, fp long, fingerprint, component_id): classes of fingerprints linked at 4 or fewer differing bits."""
    scratch, final = Scratch(docs.sparkSession), Scratch(docs.sparkSession)
    fps = final.stored(fingerprints(docs, id_col, text_col, words_a_shingle), "simhash")
    distinct = scratch.stored(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    comp = components(scratch.stored(links(distinct.select("fp")), "links"), scratch=scratch)
    member = distinct.join(comp, distinct["fp"] == comp["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    low = member.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = final.stored(member.join(low, "root").select(F.col("fp").alias("own"), "component_id"), "classes")
    scratch.drop()
    # a fingerprint that a third of all rows share makes a skewed key here, which adaptive execution splits
    return fps.join(ids, fps["fp"] == ids["own"]).select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
