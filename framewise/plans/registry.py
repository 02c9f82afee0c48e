"""Named queries with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def register(fn: Query) -> Query:
            self.queries[name] = fn
            if sql is not None:
                self.sql[name] = sql
            return fn

        return register


def r6(value: Column | str, name: str | None = None) -> Column:
    """Six decimals, no negative zero."""
    c = F.col(value) if isinstance(value, str) else value
    out = F.round(c.cast("double"), 6) + F.lit(0.0)
    return out.alias(name or (value if isinstance(value, str) else "value"))


def finite_or_null(value: Column) -> Column:
    return F.when(F.abs(value) == F.lit(float("inf")), F.lit(None).cast("double")).otherwise(value)
