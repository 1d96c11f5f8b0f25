"""Named queries over the benchmark tables, each with the SQL it must agree with."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from driftledger.fixtures import derived, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

NOW = dt.datetime(2026, 1, 1, 12, 0, 0)
NOW_TEXT = "'2026-01-01 12:00:00'"


class Tables:
    """Derived tables by attribute: ``t.corpus_d``. Each is built once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.session, self._sf_dir = spark, sf_dir
        self._known: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        return self.sql(name)

    def __getitem__(self, name: str) -> DataFrame:
        return self.base(name)

    def base(self, name: str) -> DataFrame:
        return self._once(f"@{name}", lambda: self.session.read.parquet(f"{self._sf_dir}/{name}.parquet"))

    def sql(self, text: str) -> DataFrame:
        return self._once(text, lambda: derived(self.session, self, text))

    def _once(self, key: str, build: Callable[[], DataFrame]) -> DataFrame:
        if key not in self._known:
            self._known[key] = build()
        return self._known[key]


def query(sql: str | None = None):
    """Register a function of the tables under its own name, with the SQL that gives the same rows."""

    def register(build: Callable[[Tables], DataFrame]):
        name = build.__name__
        QUERIES[name] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = oracle(sql)
        return build

    return register
