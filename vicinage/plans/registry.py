"""Registered queries and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"{name} is registered twice")
    QUERIES[name] = run
    if sql is not None:
        SQL[name] = sql


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    """Doubles that were summed in no fixed order, rounded for comparison; -0 becomes 0."""
    return df.withColumns({c: F.round(c, places) + F.lit(0.0) for c in columns})
