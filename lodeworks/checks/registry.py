"""Registered queries and the SQL each is compared with.

Every query runs over the whole provided tables. Floating-point results are
rounded on both sides; the small offset keeps exact decimal ties from falling
differently when two engines add in a different order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.sources.tables import view_sql

TIE_OFFSET = 3e-8

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function name, with its SQL if there is one."""
    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return register


def over(views: list[str], select: str, **steps: str) -> str:
    """SQL text: exploration views and further steps as CTEs, then ``select``."""
    parts = [f"{name} AS ({view_sql(name)})" for name in views]
    parts += [f"{name} AS ({text})" for name, text in steps.items()]
    return f"WITH {', '.join(parts)} {select}" if parts else select


def rounded(value: Column, digits: int = 4) -> Column:
    return F.round(value + F.lit(TIE_OFFSET), digits)


def r(expression: str, digits: int = 4) -> str:
    return f"round(({expression}) + 3e-8, {digits})"


def settled(df: DataFrame, digits: int = 4, **per_column: int) -> DataFrame:
    """Round every double column."""
    return df.select(*[
        rounded(F.col(f"`{n}`"), per_column.get(n, digits)).alias(n) if t == "double"
        else F.col(f"`{n}`")
        for n, t in df.dtypes
    ])
