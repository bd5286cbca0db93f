"""Registered queries: a Spark plan over the tables and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.base import ColumnLike, col
from ..session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Tables of one data folder by attribute: ``t.events``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return wrap


def r6(x: ColumnLike, digits: int = 6) -> Column:
    """Rounded for comparison; sums differ in the last bits between runs.

    The small offset moves exact halves off the rounding boundary, the same way in the SQL.
    """
    return F.round(col(x) + 1e-10, digits) + F.lit(0.0)


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: r6(n, digits) for n in names})


def sql_r6(x: str, digits: int = 6) -> str:
    return f"(round(CAST({x} AS DOUBLE) + 1e-10, {digits}) + 0.0)"
