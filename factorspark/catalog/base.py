"""Registration of the checked queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, folder) -> DataFrame`` with the SQL it must equal."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# Exact halves at the seventh decimal round differently in the two engines; both move off them by this much.
OFF_HALF = 3.3e-8


def r6(x: Column | str) -> Column:
    """Six decimals, and 0 never negative."""
    return F.round((F.col(x) if isinstance(x, str) else x) + F.lit(OFF_HALF), 6) + F.lit(0.0)


def q6(expr: str) -> str:
    return f"round(({expr}) + {OFF_HALF!r}, 6) + 0.0"
