"""Registration of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from registry.views import oracle, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

Views = Callable[[str], DataFrame]


def query(name: str, *views: str, sql: str | None = None):
    """Register a function of one argument, a reader of views by name."""

    def register(function: Callable[[Views], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return rounded(function(partial(view, spark, sf_dir)))

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = oracle(*views, body=sql)
        return function

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles at six decimals, as in the SQL."""
    return df.select(
        *[
            F.round(F.col(f"`{f.name}`"), digits).alias(f.name)
            if isinstance(f.dataType, T.DoubleType)
            else F.col(f"`{f.name}`")
            for f in df.schema
        ]
    )


def yyyymm(month: Column) -> Column:
    return F.year(month) * 100 + F.month(month)


def yyyymmdd(day: Column) -> Column:
    return yyyymm(day) * 100 + F.dayofmonth(day)


def r(expression: str, digits: int = 6) -> str:
    """Rounded SQL expression without a negative zero."""
    return f"round({expression}, {digits}) + 0.0"
