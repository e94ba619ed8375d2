"""Name -> (Spark query, SQL counterpart)."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, query: Query, sql: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"query '{name}' is registered twice")
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


def rounded(df: DataFrame, columns: Iterable[str], digits: int = 6) -> DataFrame:
    """Interpolated or summed doubles to a fixed number of digits, so that the order of
    additions does not show."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


def r(expr: str, digits: int = 6) -> str:
    return f"round({expr}, {digits})"
