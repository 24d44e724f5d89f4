"""What the registered queries share: table access, rounding, SQL fragments."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.sources.tables import spread_scan

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries with their check SQL (None where SQL cannot state the result)."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def keep(fn: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"query {name} is registered twice")
            self.queries[name] = fn
            if sql is not None:
                self.sql[name] = sql
            return fn

        return keep


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """A test table. Its one row group is one task, so heavy per-row work asks for `spread`."""
    found = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread_scan(found) if spread else found


def r(c: Column | str, digits: int = 6) -> Column:
    """Rounded, with a negative zero turned into zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), digits) + F.lit(0.0)


def sql_r(expression: str, digits: int = 6) -> str:
    return f"(round(({expression})::DOUBLE, {digits}) + 0.0::DOUBLE)"
