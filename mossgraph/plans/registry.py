"""Registration of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .model import Model, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register ``f(model)`` under its name; ``sql`` may name the model's views."""

    def register(f: Callable[[Model], DataFrame]) -> Callable[[Model], DataFrame]:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return f(Model(spark, folder))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = with_views(sql)
        return f

    return register


def also_as(name: str, of: str) -> None:
    """Register the query ``of`` under another name too."""
    QUERIES[name] = QUERIES[of]
    if of in ORACLE_SQL:
        ORACLE_SQL[name] = ORACLE_SQL[of]
