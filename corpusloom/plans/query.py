"""Registering an operator's Spark query beside its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.functions.dialect import DUCK, SPARK
from corpusloom.session import spread, table


class Book:
    """The queries of one plan module."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracle: dict[str, str] = {}

    def sql(self, name: str, tables: str, build: Callable[[object], str]) -> None:
        """One statement of the operator over the space-separated ``tables``."""
        self.queries[name], self.oracle[name] = self.statement(tables, build(SPARK)), build(DUCK)

    @staticmethod
    def statement(tables: str, text: str) -> Callable[[SparkSession, str], DataFrame]:
        """The query that runs Spark's ``text`` over the space-separated ``tables``."""

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            for t in tables.split():
                df = table(spark, sf_dir, t)
                (spread(df) if t == "documents" else df).createOrReplaceTempView(t)
            return spark.sql(text)

        return run

    def project(self, name: str, source: str = "documents", key: str = "doc_id", **columns: Callable[[object], str]) -> None:
        """Row-wise columns over ``source``."""
        self.sql(name, source, lambda d: f"SELECT {key}, {', '.join(f'{f(d)} AS {c}' for c, f in columns.items())} FROM {source}")

    def frame(self, name: str, run: Callable[[SparkSession, str], DataFrame], oracle: str | None = None) -> None:
        self.queries[name] = run
        if oracle:
            self.oracle[name] = oracle
