"""Registered queries of the library's own operators, each with DuckDB SQL where SQL can express it."""

from __future__ import annotations

import textwrap
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


class Tables:
    """The tables of a folder, by attribute."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(name: str, oracle: str | None = None):
    """Registers a function of Tables under a name."""

    def add(f: Callable[[Tables], DataFrame]):
        _QUERIES[name] = lambda spark, folder: f(Tables(spark, folder))
        if oracle:
            _ORACLES[name] = textwrap.dedent(oracle).strip()
        return f

    return add


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)


def _load() -> None:
    from lodestone.plans import content, events, graph, network, retrieval, search, stores  # noqa: F401  each registers its queries
