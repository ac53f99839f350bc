"""Queries by name, each with the SQL that states its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None, *ctes: str) -> Callable[[Query], Query]:
    """Name a query; ``ctes`` come before ``sql``."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = (f"WITH {', '.join(ctes)} " if ctes else "") + sql
        return f

    return add
