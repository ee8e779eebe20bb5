"""Registry of queries and their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECK_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` is left out where no SQL form exists."""

    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            CHECK_SQL[name] = sql.strip()
        return fn

    return add


def r6(c: Column | str) -> Column:
    """Six decimals, without negative zero."""
    return F.round((F.col(c) if isinstance(c, str) else c).cast("double"), 6) + F.lit(0.0)


def sql_r6(expr: str) -> str:
    return f"round(({expr})::DOUBLE, 6) + 0.0"
