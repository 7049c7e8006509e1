"""Registry of queries and their defining SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name`` with its SQL definition."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def r6(col: Column | str) -> Column:
    """Six decimals, with negative zero folded into zero."""
    col = F.col(col) if isinstance(col, str) else col
    return F.round(col.cast("double"), 6) + F.lit(0.0)


def s6(expr: str) -> str:
    """SQL text of :func:`r6`."""
    return f"(round(cast({expr} as double), 6) + 0e0)"


def fee5(expr: str) -> str:
    """SQL text of the per-level taker fee rounding."""
    return f"cast(round(cast(round({expr}, 9) as decimal(18, 9)), 5) as double)"
