"""Cleaning of locations and bills, tenure, and key filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridpanel import constants as C
from gridpanel.functions import dates, scalars
from gridpanel.operators.order_stats import exact_quantiles


def clean_locations(df: DataFrame) -> DataFrame:
    """Drop rows without coordinates; give the key its upper-case name."""
    kept = df.dropna(subset=["LAT", "LON"])
    if "NIS_RAD" not in df.columns and "nis_rad" in df.columns:
        # Names differing only in case cannot stand side by side; the key is renamed.
        kept = kept.withColumnRenamed("nis_rad", "NIS_RAD")
    return kept


def clean_bills(df: DataFrame, q: float = C.OUTLIER_QUANTILE) -> DataFrame:
    """Distinct bills with parsed dates, without consumption above quantile `q`.

    The quantile is taken after removing duplicates and ignores NULLs; bills without
    consumption are dropped by the comparison.
    """
    bills = df.dropDuplicates()
    if "f_fact" in df.columns:
        bills = bills.withColumn("f_fact", dates.parse_day_first(df, "f_fact"))
    if "period" in df.columns:
        bills = bills.withColumn("period", dates.month(dates.parse_day_first(df, "period")))
    if "csmo_fact" in df.columns:
        # All bills are one group: large, there is no need to measure it.
        limit = exact_quantiles(bills, "csmo_fact", {"limit": q})
        bills = bills.filter(F.col("csmo_fact") <= limit.scalar())
    return bills


def filter_valid(
    df: DataFrame,
    lat: str = "LAT",
    lon: str = "LON",
    bounds: dict | None = None,
    filter_valid: bool = True,
) -> DataFrame:
    """Rows with usable coordinates; everything if the filter is off."""
    if not filter_valid:
        return df
    return df.filter(scalars.valid_coordinates(F.col(lat), F.col(lon), bounds))


def attach_locations(
    bills: DataFrame, locations: DataFrame, columns: Sequence[str] = ("LAT", "LON"), key: str = "nis_rad"
) -> DataFrame:
    """Left join of location columns on bill key = NIS_RAD."""
    side = locations.select(F.col("NIS_RAD").alias("_key"), *columns)
    return bills.join(side, F.col(key) == F.col("_key"), "left").drop("_key")


def add_tenure(bills: DataFrame, locations: DataFrame) -> DataFrame:
    """Installation date and whole months since connection; NULL dates give NULL."""
    side = locations.withColumn("installation", dates.parse_day_first(locations, "installation"))
    joined = attach_locations(bills, side, ["installation"])
    return joined.withColumn(
        "months_since_connection",
        dates.months_between_instants(F.col("f_fact"), F.col("installation")),
    )


def keep_keys(df: DataFrame, keys: DataFrame, on: str, key: str | None = None) -> DataFrame:
    """Rows whose key occurs in `keys`."""
    side = keys.select(F.col(key or on).alias("_key"))
    return df.join(side, F.col(on) == F.col("_key"), "left_semi")


def drop_keys(df: DataFrame, keys: DataFrame, on: str, key: str | None = None) -> DataFrame:
    """Rows whose key does not occur in `keys`."""
    side = keys.select(F.col(key or on).alias("_key"))
    return df.join(side, F.col(on) == F.col("_key"), "left_anti")


def within_tenure(
    df: DataFrame, max_months: int, inclusive: bool, column: str = "Nof_Mths"
) -> DataFrame:
    """Rows up to a number of months, with or without the limit itself."""
    limit: Column = F.col(column) <= max_months if inclusive else F.col(column) < max_months
    return df.filter(limit)


def first_per_key(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """One row per key: the first by the given columns."""
    rest = [c for c in df.columns if c != key]
    # min over a struct combines on the map side, unlike a ranked window.
    best = F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("_first")
    first = df.groupBy(key).agg(best)
    return first.select(key, *[F.col(f"_first.{c}").alias(c) for c in rest])
