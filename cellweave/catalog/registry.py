"""Registration of queries and of the SQL that must agree with them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function (spark, folder) -> DataFrame, and its SQL form."""

    def wrap(function):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql.strip()
        return function

    return wrap


def rounded(column: Column | str, decimals: int = 6) -> Column:
    """Round and turn -0.0 into 0.0, so values hash alike in both engines."""
    column = F.col(column) if isinstance(column, str) else column
    return F.round(column, decimals) + F.lit(0.0)


def round_columns(df: DataFrame, columns: Sequence[str], decimals: int = 6) -> DataFrame:
    return df.select(*[rounded(c, decimals).alias(c) if c in columns else F.col(c) for c in df.columns])


def R(expression: str, decimals: int = 6) -> str:
    """The same rounding in SQL."""
    return f"(round(CAST({expression} AS DOUBLE), {decimals}) + 0.0::DOUBLE)"
