"""Registered catalogue queries, by theme. Each query stands beside the DuckDB SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lumenshelf.sources.fixtures import Catalog, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of a Catalog under a name, with SQL over the catalogue's views."""

    def register(make: Callable[[Catalog], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: make(Catalog(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = oracle(sql)
        return make

    return register
