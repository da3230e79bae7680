"""Registry of checked queries: a Spark callable and, where SQL can say it, an oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def rounded(df: DataFrame, *columns: str, digits: int = 8) -> DataFrame:
    """Double columns rounded for comparison, as float sums depend on the order of the rows."""
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in columns})


def r8(expression: str, name: str) -> str:
    return f"round(cast({expression} as double), 8) AS {name}"
