"""Every query with an oracle gives the oracle's rows on the smallest tables; the others run."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from corpusloom.plans import registry

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = registry.queries(), registry.oracle_sql()


def plain(v):
    if isinstance(v, bool):
        return float(v)
    if isinstance(v, float):
        return None if v != v else round(v, 8) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return float(v) if hasattr(v, "as_tuple") else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    cur = duck.execute(ORACLE[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 100
    assert set(entry.oracle_sql()) <= set(entry.queries())
