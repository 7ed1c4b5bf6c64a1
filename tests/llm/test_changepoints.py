import math
import random
from collections import defaultdict
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import changepoints as cp
from corpusloom.llm import queries
from corpusloom.session import table


def brute(x, least=5, penalty=10000):
    def cost(a, b):
        n, s, q = b - a, sum(x[a:b]), sum(v * v for v in x[a:b])
        return n * math.floor(1000 * math.log(1 + (n * q - s * s) // (n * n)))

    if len(x) < least:
        return cost(0, len(x)), [0]
    best = {0: (0, 0, ())}
    for t in range(least, len(x) + 1):
        best[t] = min((best[a][0] + cost(a, t) + penalty, best[a][1] + 1, (a, *best[a][2])) for a in best if a <= t - least)
    total, _, starts = best[len(x)]
    return total - penalty, list(reversed(starts))


def cases():
    r = random.Random(5)
    out = [[0] * 12, [7], [1, 2, 3, 4], [3] * 5, [0, 0, 0, 0, 0, 9, 9, 9, 9, 9], [5] * 10 + [400] * 10 + [5] * 10]
    for n in (6, 11, 17, 30, 41):
        out += [[r.randrange(4) for _ in range(n)], [r.randrange(3000) for _ in range(n)], [r.choice((0, 50)) * (1 + i // 9) for i in range(n)]]
    return out


@pytest.mark.parametrize("huge", [1, 10**11])
def test_series_against_brute_force(spark, huge):
    all_ = [[v * huge for v in x] for x in cases()]
    rows = [(f"k{i}", [100 + d for d, v in enumerate(x) if v or d in (0, len(x) - 1)], [v for d, v in enumerate(x) if v or d in (0, len(x) - 1)]) for i, x in enumerate(all_)]
    if huge == 1:
        got = defaultdict(list)
        for r in cp.segments(spark.createDataFrame(rows, "key string, days array<long>, totals array<long>"), "key", cells=64).collect():
            got[r.key].append(r)
        for i, x in enumerate(all_):
            total, starts = brute(x)
            mine = sorted(got[f"k{i}"], key=lambda r: r.segment_no)
            assert [r.first_day - 100 for r in mine] == starts and {r.best_cost for r in mine} == {total}
            assert [r.segment_no for r in mine] == list(range(1, len(starts) + 1)) and {r.n_segments for r in mine} == {len(starts)}
            assert sum(r.total for r in mine) == sum(x) and sum(r.n_days for r in mine) == len(x)
            assert sum(r.cost for r in mine) + 10000 * (len(mine) - 1) == total
    else:  # products beyond 64 bits
        for x in all_:
            v = np.array([x], object)
            _, start, *_, whole = cp.cut(v, np.array([len(x)]))
            total, starts = brute(x)
            assert start.tolist() == starts and set(whole.tolist()) == {total}


def test_rows_become_series(spark):
    d = lambda i: datetime(2024, 1, 1, 5) + timedelta(days=i)
    rows = [(1, 2, "kept", d(0), "x")] * 2 + [(1, 3, "swapped", d(3), "x"), (1, 9, "returned", d(9), "x"), (1, None, "kept", d(20), "x"), (1, 5, "kept", None, "x"), (1, 5, None, d(30), "x"), (None, 4, "kept", d(1), "x")]
    df = spark.createDataFrame(rows, "vendor_id long, quantity int, flag string, shipped_at timestamp_ntz, days string").withColumn("totals", F.lit(1)).withColumn("key", F.lit(2))
    first = (date(2024, 1, 1) - date(1970, 1, 1)).days
    got = {r.vendor_id: r for r in cp.vendor_segments(df).collect()}
    assert (got[1].first_day, got[1].n_days, got[1].total, got[1].spread) == (first, 4, 7, 1 + (4 * 25 - 49) // 16)
    assert (got[None].first_day, got[None].n_days, got[None].total, got[None].cost) == (first + 1, 1, 4, 0)
    assert cp.vendor_segments(df.limit(0)).count() == 0


def test_query_against_brute_force(spark, sf):
    lines = table(spark, sf, "sale_lines").where("flag in ('kept', 'swapped') and quantity is not null and shipped_at is not null")
    sums = defaultdict(lambda: defaultdict(int))
    for r in lines.select("vendor_id", F.unix_date(F.to_date("shipped_at")).alias("day"), "quantity").collect():
        sums[r.vendor_id][r.day] += r.quantity
    got = defaultdict(list)
    for r in queries.op11_changepoints(spark, sf).collect():
        got[r.vendor_id].append(r)
    assert set(got) == set(sums)
    for k, days in sums.items():
        low = min(days)
        total, starts = brute([days.get(i, 0) for i in range(low, max(days) + 1)])
        mine = sorted(got[k], key=lambda r: r.segment_no)
        assert [r.first_day - low for r in mine] == starts and mine[0].best_cost == total


def test_nothing_is_broadcast_or_single(spark, sf):
    plan = queries.op11_changepoints(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SinglePartition" not in plan and "MapInArrow" in plan
