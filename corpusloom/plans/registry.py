"""Name -> query and name -> oracle SQL of the analytics operators.

Each plan module exposes ``QUERIES`` (name -> callable(spark, sf_dir)) and ``ORACLE``
(name -> DuckDB SQL), side by side so that they change together.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.plans import corpus, procedural, relational, retrieval, scores, text

MODULES = (text, corpus, relational, scores, retrieval, procedural)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for m in MODULES:
        out.update(m.QUERIES)
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in MODULES:
        out.update(m.ORACLE)
    return out
