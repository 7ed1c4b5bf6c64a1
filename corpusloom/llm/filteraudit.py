"""How a chain of filters interacts: every order, step by step, and each filter's Shapley share.

Each document becomes a mask of the filters that it fails; documents are counted per part and mask
(aggregated before the shuffle), so at most 2^n cells a part are left, whatever the number of documents.
The orders are then visited by adjacent transpositions: each next order swaps two neighbouring filters, so
only those two steps are counted anew from the mask cells; a filter's removals add up to its Shapley sum
along the walk. Parts are walked many at a time as numpy tensors inside ``mapInArrow``, and may be any number.

The duplicate filter E needs the whole table: texts meet as SHA-256 digests, the smallest id of a digest is
found by an aggregation (a text with a third of all rows costs one row a partition), and rows look up their
own (digest, id) among those, a key that no hot text burdens.

Defined results: null texts are empty, null sources the empty string; repeated rows count each, and rows that
share the smallest id of a text are all its first copy; a null id is neither smaller nor larger than another,
so such rows never fail E and make none fail; several label rows of an id count as 1 if any is 1, null labels as
0; an empty table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import Scratch

COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def swaps(n: int) -> Iterator[int]:
    """Positions i, one after another, at which swapping i and i + 1 leads through all orders of ``n`` things."""
    if n < 2:
        return
    down = True  # the last thing travels down and up; between, the others make one swap
    for inner in [*swaps(n - 1), None]:
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        if inner is not None:
            yield inner + down
        down = not down


def walk(cells: np.ndarray, names: str) -> tuple[list[str], np.ndarray]:
    """(orders, counts[part, order, step, 7]) from ``cells[part, mask, (documents, good, toxic)]``; bit i of a mask is ``names[i]``."""
    n, parts = len(names), len(cells)
    masks = np.arange(1 << n)
    bits = [1 << i for i in range(n)]
    fails = [cells[:, masks & b > 0, 0].sum(1) for b in bits]
    unique = [cells[:, b, 0] for b in bits]
    order, orders = list(range(n)), []
    now = np.zeros((parts, n, len(COUNTS)), np.int64)
    out, share = [], np.zeros((parts, n), np.int64)

    def count(step: int) -> None:
        f, before = order[step], sum(bits[x] for x in order[:step])
        lost = cells[:, (masks & before == 0) & (masks & bits[f] > 0)].sum(1)
        now[:, step, 0] = cells[:, masks & (before | bits[f]) == 0, 0].sum(1)
        now[:, step, 1], now[:, step, 2], now[:, step, 3] = lost[:, 0], fails[f] - lost[:, 0], unique[f]
        now[:, step, 4:6] = lost[:, 1:]

    def note() -> None:
        orders.append("".join(names[x] for x in order))
        out.append(now.copy())
        share[:, order] += now[:, :, 1]

    for step in range(n):
        count(step)
    note()
    for i in swaps(n):
        order[i], order[i + 1] = order[i + 1], order[i]
        count(i)
        count(i + 1)
        note()
    made = np.stack(out, 1)
    for k, o in enumerate(orders):
        made[:, k, :, 6] = share[:, [names.index(x) for x in o]]
    return orders, made


def audit(cells: DataFrame, names: str, parts_at_once: int = 64) -> DataFrame:
    """``cells`` (part, mask, n, good, toxic; one row a part and mask) to a row per part, order and step."""
    wide = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, parts_at_once):
                b = whole.slice(at, parts_at_once)
                lists = b.column(1)
                row = np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
                mask, *values = (x.to_numpy() for x in lists.flatten().flatten())
                tensor = np.zeros((b.num_rows, 1 << wide, 3), np.int64)
                tensor[row, mask] = np.stack(values, 1)
                orders, made = walk(tensor, names)
                each = len(orders) * wide
                made = made.reshape(-1, len(COUNTS))
                yield pa.record_batch(
                    [
                        b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), each))),
                        pa.array(np.repeat(orders, wide).tolist() * b.num_rows),
                        pa.array(np.tile(np.arange(1, wide + 1), len(made) // wide), pa.int32()),
                        *[pa.array(made[:, k]) for k in range(len(COUNTS))],
                    ],
                    names=["part", "filter_order", "step", *COUNTS],
                )

    tables = cells.groupBy("part").agg(F.collect_list(F.struct(F.col("mask").cast("int").alias("mask"), "n", "good", "toxic")).alias("cells"))
    return tables.mapInArrow(run, f"part string, filter_order string, step int, {', '.join(f'{c} long' for c in COUNTS)}")


def facts(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask of A to D, SHA-256 of the text) of each row; the text is read once and not carried on."""
    d = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    d = d.withColumn("w", F.filter(F.split("t", r"[\x20\x09-\x0D]+"), lambda x: x != ""))
    a = F.size("w") < 200
    b = F.size(F.array_distinct("w")).cast("long") * 100 < F.size("w").cast("long") * 50
    upper = (F.octet_length("t") - F.octet_length(F.translate("t", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long")
    c = upper * 100 > F.length("t").cast("long") * 2
    held = F.col("t").rlike(r"[#$%&*|]")
    mask = sum((x.cast("int") * (1 << i) for i, x in enumerate((a, b, c, held))), F.lit(0))
    return d.select("doc_id", "part", mask.alias("mask"), F.unhex(F.sha2(F.col("t").cast("binary"), 256)).alias("digest"))


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The five filters A to E over ``docs``, audited per source."""
    scratch = Scratch(docs.sparkSession)
    rows = scratch.stored(facts(docs), "facts")
    first = rows.where(F.col("doc_id").isNotNull()).groupBy(F.col("digest").alias("of")).agg(F.min("doc_id").alias("first"))
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("labelled")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    flagged = rows.join(first, (F.col("digest") == F.col("of")) & (F.col("doc_id") == F.col("first")), "left").join(known, F.col("doc_id") == F.col("labelled"), "left")
    copy = (F.col("doc_id").isNotNull() & F.col("first").isNull()).cast("int") * 16
    of = flagged.groupBy("part", (F.col("mask") + copy).alias("mask"))
    cells = scratch.stored(of.agg(F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")), "cells")
    scratch.drop(rows)
    return audit(cells, "ABCDE")


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
l AS (SELECT doc_id AS labelled, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, (len(ws) < 200)::INT + 2 * (100 * list_unique(ws) < 50 * len(ws))::INT
  + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > first, false)::INT AS mask FROM w LEFT JOIN l ON doc_id = labelled),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY 1, 2),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS b),
o AS (SELECT f1.x || f2.x || f3.x || f4.x || f5.x AS filter_order, [f1.b, f2.b, f3.b, f4.b, f5.b] AS bs FROM f f1, f f2, f f3, f f4, f f5 WHERE f1.b + f2.b + f3.b + f4.b + f5.b = 31 AND len(list_distinct([f1.b, f2.b, f3.b, f4.b, f5.b])) = 5),
s AS (SELECT filter_order, step, bs[step] AS b, coalesce(list_sum(bs[1:step - 1]), 0)::INT AS before FROM (SELECT *, unnest([1, 2, 3, 4, 5]) AS step FROM o) x),
r AS (SELECT part, filter_order, step, b, coalesce(sum(n) FILTER (mask & (before | b) = 0), 0) AS kept, coalesce(sum(n) FILTER (mask & before = 0 AND mask & b > 0), 0) AS removed,
  coalesce(sum(n) FILTER (mask & before > 0 AND mask & b > 0), 0) AS redundant, coalesce(sum(n) FILTER (mask = b), 0) AS unique_fails,
  coalesce(sum(good) FILTER (mask & before = 0 AND mask & b > 0), 0) AS good_lost, coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & b > 0), 0) AS toxic_lost FROM c CROSS JOIN s GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, b))::BIGINT AS shapley FROM r
"""
