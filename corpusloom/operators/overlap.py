"""What is counted within documents: n-grams of two texts, weights and likeness of sentences. One document at a time in memory, none is shuffled."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import stored


def together(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """``rows`` with their other columns as arrays, one row a key. Only rows that repeat a key are shuffled; the columns may not be null."""
    columns = [c for c in rows.columns if c != key]
    repeated = stored(rows.groupBy(F.col(key).alias("of")).count().where("count > 1").select("of"), "repeated")
    if not repeated.limit(1).count():
        return rows.select(key, *[F.array(c).alias(c) for c in columns])
    same = F.col(key).eqNullSafe(F.col("of"))
    lone = rows.join(repeated, same, "left_anti").select(key, *[F.array(c).alias(c) for c in columns])
    many = rows.join(repeated, same, "left_semi").groupBy(key).agg(*[F.collect_list(c).alias(c) for c in columns])
    return lone.unionByName(many)


def common(pred: list[list[str]], ref: list[list[str]], n: int) -> tuple[float, int, int]:
    """(common n-grams, each as often as the side that has it less; n-grams of ``pred``; n-grams of ``ref``); none crosses from one word list to the next."""
    grams = lambda lists: (g for w in lists for g in zip(*(w[k:] for k in range(n))))
    many = lambda lists: sum(max(0, len(w) - n + 1) for w in lists)
    wanted = Counter(grams(pred))
    found = Counter(filter(wanted.__contains__, grams(ref)))
    return float(sum(min(c, wanted[g]) for g, c in found.items())), many(pred), many(ref)


def overlaps(rows: DataFrame, grams: tuple[int, ...], key: str = "doc_id") -> DataFrame:
    """(key, hits{n}, np{n}, nr{n}) of ``rows`` (key, pred, ref), whose texts are words joined by spaces; see ``common``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for pred, ref in zip(b.column("pred"), b.column("ref")):
                lists = [[t.split() for t in side.as_py()] for side in (pred, ref)]
                found.append([x for n in grams for x in common(*lists, n)])
            columns = list(zip(*found)) or [[]] * (3 * len(grams))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.int64() if i % 3 else pa.float64()) for i, c in enumerate(columns)]], names=names)

    names = [key, *[f"{x}{n}" for n in grams for x in ("hits", "np", "nr")]]
    kind = rows.schema[key].dataType.simpleString()
    schema = ", ".join([f"{key} {kind}", *[f"{c} {'double' if c.startswith('hits') else 'long'}" for c in names[1:]]])
    return together(rows, key).select(key, "pred", "ref").mapInArrow(run, schema)
