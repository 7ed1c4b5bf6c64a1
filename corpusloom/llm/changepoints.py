"""Penalised change points of many daily series at once.

Rows are summed per key and day before they are shuffled, so a key with a third of all rows costs a
row per day and input partition. A key's days then meet in one row, and ``mapInArrow`` cuts all series
of a batch together: they are ordered by length, padded into numpy tensors of bounded size, and one
sweep over the days updates every series and every possible start of its last segment at once. Starts
that would leave a segment shorter than the minimum are masked; ``argmin`` takes the earliest of equals.

Integers are exact: a tensor works in 64 bits if no product can pass them, else with whole numbers of
any size. Work grows with the square of a series' days and memory with the days themselves, however
many rows stand behind a day.

Defined results: rows with a null day or value, or flagged otherwise, take no part; repeated rows count
each; a null key is a series of its own; days between the first and the last without any row count 0;
a series shorter than the minimum is one segment; an empty table gives no rows; other columns are not
read, whatever their names. A segment's total or spread beyond a long is an error, not clipped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FAR = np.int64(1) << 62
COLUMNS = ("segment_no int", "first_day long", "n_days long", "total long", "spread long", "cost long", "n_segments long", "best_cost long")


def daily_series(rows: DataFrame, key: str, day: Column, value: Column) -> DataFrame:
    """(key, days array<long>, totals array<long>), days ascending; one row a key."""
    daily = rows.select(F.col(f"`{key}`").alias("key"), day.cast("long").alias("day"), value.cast("long").alias("value")).where(F.col("day").isNotNull() & F.col("value").isNotNull())
    daily = daily.groupBy("key", "day").agg(F.sum("value").alias("total"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a few bytes a key, but much work: not to be coalesced by size
    points = F.array_sort(F.collect_list(F.struct("day", "total")))
    return daily.repartition(parts, "key").groupBy("key").agg(points.alias("p")).select(F.col("key").alias(key), F.col("p.day").alias("days"), F.col("p.total").alias("totals"))


def spread_of(n, total, squares):
    """1 + floor of the variance, exact."""
    return 1 + (n * squares - total * total) // (n * n)


def level_cost(n, spread, scale: int):
    return n * np.floor(scale * np.log(np.asarray(spread).astype(np.float64))).astype(np.int64)


def sums(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of the values and of their squares along each row, from 0."""
    zero = np.zeros((len(values), 1), values.dtype)
    return np.concatenate([zero, values.cumsum(1)], 1), np.concatenate([zero, (values * values).cumsum(1)], 1)


def cut(values: np.ndarray, lengths: np.ndarray, least: int = 5, penalty: int = 10000, scale: int = 1000) -> tuple[np.ndarray, ...]:
    """The best segments of each row of ``values`` (rows padded with zeros beyond ``lengths``).

    Returns (row, start, end, total, spread, cost, number of segments, best cost), ordered by row and start.
    Fewest segments among equal costs, then the earliest last start, then the same for what is before it.
    """
    b, n = values.shape
    s, q = sums(values)
    fold = n // least + 2  # cost and number of segments in one number: cost * fold + segments
    best = np.full((b, n + 1), FAR, np.int64)
    best[:, 0] = 0
    last = np.zeros((b, n + 1), np.int64)
    for t in range(least, n + 1):
        starts = t - least + 1
        days = t - np.arange(starts)
        spread = spread_of(days, s[:, t : t + 1] - s[:, :starts], q[:, t : t + 1] - q[:, :starts])
        reach = best[:, :starts]
        key = np.where(reach < FAR, reach + (level_cost(days, spread, scale) + penalty) * fold + 1, FAR)
        at = key.argmin(1)
        last[:, t], best[:, t] = at, key[np.arange(b), at]
    row, end, segments = np.arange(b), lengths.copy(), []
    while len(row):
        start = np.where(lengths[row] < least, 0, last[row, end])
        segments.append((row, start, end))
        row, end = row[start > 0], start[start > 0]
    row, start, end = (np.concatenate(x) for x in zip(*segments)) if segments else (np.zeros(0, np.int64),) * 3
    order = np.lexsort((start, row))
    row, start, end = row[order], start[order], end[order]
    total = s[row, end] - s[row, start]
    spread = spread_of(end - start, total, q[row, end] - q[row, start])
    cost = level_cost(end - start, spread, scale)
    many = np.bincount(row, minlength=b)
    whole = np.bincount(row, cost, b).astype(np.int64) + penalty * (many - 1)
    return row, start, end, total, spread, cost, many[row], whole[row]


def tensors(first: np.ndarray, length: np.ndarray, offsets: np.ndarray, days: np.ndarray, totals: np.ndarray, cells: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places of the series, padded values): series of like length together, at most ``cells`` numbers a tensor or one series."""
    square = np.add.reduceat(totals.astype(np.float64) ** 2, offsets[:-1]) if len(length) else np.zeros(0)
    big = square * length >= 2.0**61  # n * Q bounds S * S, too
    for huge in (False, True):
        order = np.flatnonzero(big == huge)
        order = order[np.argsort(length[order], kind="stable")]
        i = 0
        while i < len(order):
            j = i + 1
            while j < len(order) and (j + 1 - i) * length[order[j]] <= cells:
                j += 1
            at = order[i:j]
            v = np.zeros((len(at), length[at[-1]]), object if huge else np.int64)
            for r, k in enumerate(at):
                x = slice(offsets[k], offsets[k + 1])
                v[r, days[x] - first[k]] = [int(y) for y in totals[x]] if huge else totals[x]
            yield at, v
            i = j


def segments(series: DataFrame, key: str, least: int = 5, penalty: int = 10000, scale: int = 1000, cells: int = 1 << 18) -> DataFrame:
    """One row a segment of each series (``key``, days, totals): see COLUMNS; ``first_day`` counts like ``days``."""
    kind = series.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            lists = b.column(1)
            offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            days, totals = lists.flatten().to_numpy(), b.column(2).flatten().to_numpy()
            first = days[offsets[:-1]]
            length = days[offsets[1:] - 1] - first + 1
            for at, v in tensors(first, length, offsets, days, totals, cells):
                row, start, end, total, spread, cost, many, whole = cut(v, length[at], least, penalty, scale)
                number = np.arange(len(row)) - np.searchsorted(row, row) + 1
                longs = (first[at][row] + start, end - start, total, spread, cost, many, whole)
                yield pa.record_batch([b.column(0).take(pa.array(at[row])), pa.array(number, pa.int32()), *[pa.array(list(x) if x.dtype == object else x, pa.int64()) for x in longs]], names=[key, *[c.split()[0] for c in COLUMNS]])

    return series.select(key, "days", "totals").mapInArrow(run, f"`{key}` {kind}, {', '.join(COLUMNS)}")


def vendor_segments(lines: DataFrame) -> DataFrame:
    """Change points of each vendor's daily quantity over lines flagged kept or swapped."""
    taken = lines.where(F.col("flag").isin("kept", "swapped"))
    return segments(daily_series(taken, "vendor_id", F.unix_date(F.col("shipped_at").cast("date")), F.col("quantity")), "vendor_id")


ORACLE = """
WITH RECURSIVE g AS (SELECT vendor_id, datediff('day', DATE '1970-01-01', shipped_at::DATE) AS day, sum(quantity)::HUGEINT AS q FROM sale_lines
  WHERE flag IN ('kept', 'swapped') AND quantity IS NOT NULL AND shipped_at IS NOT NULL GROUP BY 1, 2),
b AS (SELECT vendor_id, min(day) AS d0, max(day) AS d1 FROM g GROUP BY 1),
e AS (SELECT vendor_id, d0, unnest(range(d0, d1 + 1)) AS day FROM b),
v AS (SELECT e.vendor_id, e.d0, list(coalesce(q, 0::HUGEINT) ORDER BY e.day) AS x FROM e LEFT JOIN g ON e.vendor_id IS NOT DISTINCT FROM g.vendor_id AND e.day = g.day GROUP BY 1, 2),
p AS (SELECT vendor_id, d0, len(x) AS n, least(5, len(x)) AS few, list_transform(range(0, len(x) + 1), lambda i: coalesce(list_sum(x[1:i]), 0)::HUGEINT) AS s,
  list_transform(range(0, len(x) + 1), lambda i: coalesce(list_sum(list_transform(x[1:i], lambda y: y * y)), 0)::HUGEINT) AS r FROM v),
k AS (SELECT vendor_id, 0 AS t, [0::HUGEINT] AS best, [0::BIGINT] AS back FROM p
  UNION ALL SELECT vendor_id, t, list_append(best, coalesce(list_min(c), 1000000000000000000::HUGEINT)), list_append(back, coalesce(list_position(c, list_min(c)), 1)::BIGINT - 1) FROM (
    SELECT k.vendor_id, k.t + 1 AS t, best, back, list_transform(range(0, k.t + 2 - few), lambda i: best[i + 1] + 1 + 1000000 * (10000 +
      (k.t + 1 - i) * floor(1000 * ln((1 + ((k.t + 1 - i) * (r[k.t + 2] - r[i + 1]) - (s[k.t + 2] - s[i + 1]) * (s[k.t + 2] - s[i + 1])) // ((k.t + 1 - i) * (k.t + 1 - i)))::DOUBLE))::HUGEINT)) AS c
    FROM k JOIN p ON k.vendor_id IS NOT DISTINCT FROM p.vendor_id WHERE k.t < p.n) step),
f AS (SELECT p.*, best, back FROM p JOIN k ON k.vendor_id IS NOT DISTINCT FROM p.vendor_id AND k.t = p.n),
w AS (SELECT vendor_id, n AS stop, back[n + 1] AS start FROM f UNION ALL SELECT w.vendor_id, w.start, back[w.start + 1] FROM w JOIN f ON w.vendor_id IS NOT DISTINCT FROM f.vendor_id WHERE w.start > 0),
z AS (SELECT f.vendor_id, d0 + start AS first_day, stop - start AS n_days, s[stop + 1] - s[start + 1] AS total, r[stop + 1] - r[start + 1] AS q FROM w JOIN f ON w.vendor_id IS NOT DISTINCT FROM f.vendor_id),
y AS (SELECT *, 1 + (n_days * q - total * total) // (n_days * n_days) AS spread FROM z), x AS (SELECT *, n_days * floor(1000 * ln(spread::DOUBLE)) AS cost FROM y)
SELECT vendor_id, row_number() OVER (PARTITION BY vendor_id ORDER BY first_day)::INT AS segment_no, first_day::BIGINT AS first_day, n_days::BIGINT AS n_days, total::BIGINT AS total, spread::BIGINT AS spread, cost::BIGINT AS cost,
  count(*) OVER (PARTITION BY vendor_id)::BIGINT AS n_segments, (sum(cost) OVER (PARTITION BY vendor_id) + 10000 * (count(*) OVER (PARTITION BY vendor_id) - 1))::BIGINT AS best_cost FROM x
"""
