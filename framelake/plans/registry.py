"""Queries by name, each with the SQL that must give the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def near(x: Column, places: int = 6) -> Column:
    """x rounded by plain arithmetic, as near_sql() does it."""
    return F.floor(x * float(10**places) + 0.5) / float(10**places)


def near_sql(x: str, places: int = 6) -> str:
    return f"floor(({x}) * {10**places}::DOUBLE + 0.5::DOUBLE) / {10**places}::DOUBLE"
