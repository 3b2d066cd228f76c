"""Where plans register queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..fixtures import Tables, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers `plan(tables) -> DataFrame` under `name`, with the SQL that DuckDB answers alike."""

    def keep(plan: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is there twice")
        QUERIES[name] = lambda spark, folder: plan(Tables(spark, folder))
        if sql:
            ORACLES[name] = with_views(sql)
        return plan

    return keep
