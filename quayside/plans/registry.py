"""The register of queries: name, DataFrame plan, SQL twin and the inventory rows it covers."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

FLAGSHIP = "company_cards"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
COVERS: dict[str, tuple[str, ...]] = {}


class Tables:
    """The parquet tables of a folder as attributes."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self._spark.read.parquet(f"{self._folder}/{name}.parquet")


def query(*rows: str, sql: str | None = None, name: str | None = None):
    """Register a function of Tables under its name; rows: the inventory ids that it exercises."""

    def put(f: Callable[[Tables], DataFrame]):
        key = name or f.__name__
        assert key not in QUERIES, key
        QUERIES[key] = lambda spark, folder: f(Tables(spark, folder))
        COVERS[key] = rows
        if sql:
            ORACLES[key] = sql
        return f

    return put


for _module in ("relational", "aggregates", "sequences", "merges", "texts", "models", "campaigns", "identity", "contacts", "links", "companies", "proximity", "verdicts", "streams"):
    importlib.import_module(f"quayside.plans.{_module}")
