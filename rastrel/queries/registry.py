"""Registry of runnable queries and their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(check: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with the DuckDB text that must give the same rows."""
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if check:
            CHECKS[fn.__name__] = check
        return fn
    return add
