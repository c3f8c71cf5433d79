"""Growth curves by months since connection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpanel import constants as C
from gridpanel.operators.order_stats import grouped_statistics, null_safe_join

QUARTILES = {"Qrtl1": 0.25, "Median": 0.5, "Qrtl3": 0.75}


def growth_curve(
    df: DataFrame,
    by: Sequence[str] = ("Nof_Mths",),
    value: str = "csmo_fact",
    attach: bool = False,
    min_count: int | None = None,
    keep_null_groups: bool = False,
) -> DataFrame:
    """Quartiles, median and row count of consumption per group.

    `attach` returns the input rows with the quartiles of their group added (rows
    without a group get NULL); `min_count` keeps groups of at least that many rows.
    """
    by = list(by)
    rows = df if keep_null_groups else df.dropna(subset=by)
    curve = grouped_statistics(rows, value, by, QUARTILES, {"count": "rows"})
    if min_count is not None:
        curve = curve.filter(F.col("count") >= min_count)
    if attach:
        return null_safe_join(df, curve.drop("count"), by)
    return curve.select(*by, *QUARTILES, "count")


def calendar_curve(df: DataFrame, month: str = "Month", value: str = "csmo_fact") -> DataFrame:
    return growth_curve(df, [month], value, keep_null_groups=True)


def connection_year_curve(
    df: DataFrame,
    max_months: int | None = C.MAX_MONTHS_PLOT,
    min_year: int = C.FIRST_CONNECTION_YEAR,
    min_count: int = 1201,
) -> DataFrame:
    """Curves by year of connection, for the years and months with enough bills."""
    rows = df.filter(F.col("Year_of_connection") >= min_year)
    if max_months is not None:
        rows = rows.filter(F.col("Nof_Mths") < max_months)
    return growth_curve(rows, ["Nof_Mths", "Year_of_connection"], min_count=min_count)


def class_curve(
    bills: DataFrame,
    classified: DataFrame,
    max_months: int = 125,
    by: Sequence[str] = ("classification", "Nof_Mths"),
) -> DataFrame:
    """Curves per settlement class, leaving out 'NA'."""
    classes = (
        classified.filter(F.col("classification") != "NA")
        .select(F.col("NIS_RAD").alias("_key"), "classification")
        .dropDuplicates()
    )
    rows = bills.join(classes, F.col("nis_rad") == F.col("_key")).drop("_key")
    return growth_curve(rows.filter(F.col("Nof_Mths") <= max_months), by)
