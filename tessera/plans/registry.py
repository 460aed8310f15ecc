"""The registered queries of image and annotation analytics, each beside SQL with the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.sources.fixtures import oracle

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(*views: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name; sql reads the derived tables named in views."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = oracle(sql, *views)
        return f

    return add
