"""The feature table: bills with everything around their customer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridpanel import constants as C
from gridpanel.functions import dates
from gridpanel.operators.cleaning import attach_locations
from gridpanel.operators.order_stats import null_safe_join
from gridpanel.operators.proximity import count_in_radius, electrified_structures
from gridpanel.operators.raster import lights_features, population_features
from gridpanel.operators.roads import road_features

FEATURE_KEYS = ("nis_rad", "period", "year")

# Extraction name -> name the panel analysis reads.
ANALYSIS_NAMES = {
    "months_since_connection": "Nof_Mths",
    "distance_to_road": "min_dist2_road",
    "lights_mean": "Night_Lights",
}


def unique_on(feature: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The feature, failing at run time where its keys occur twice.

    The check groups by the join keys, so it shares the shuffle of the join.
    """
    rest = [c for c in feature.columns if c not in keys]
    counted = feature.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.first(F.struct(*rest)).alias("_f")
    )
    message = F.lit(f"feature rows are not unique on {', '.join(keys)}")
    checked = F.when(F.col("_n") > 1, F.raise_error(message)).otherwise(F.col("_f"))
    return counted.select(*keys, checked.alias("_f")).select(*keys, "_f.*")


def assemble_features(bills: DataFrame, locations: DataFrame, *features: DataFrame) -> DataFrame:
    """Bills with location and features, as many rows as bills.

    Each feature is joined on those of `nis_rad`, `period` and `year` it has, on which
    it must be unique.
    """
    table = attach_locations(bills, unique_on(locations.select("NIS_RAD", "LAT", "LON"), ["NIS_RAD"]))
    if "year" not in table.columns:
        table = table.withColumn("year", dates.bill_year(table))
    for feature in features:
        keys = [k for k in FEATURE_KEYS if k in feature.columns and k in table.columns]
        if "nis_rad" not in keys:
            raise ValueError("a feature needs the column nis_rad")
        table = table.join(unique_on(feature, keys), keys, "left")
    return table


def extract_features(
    bills: DataFrame,
    locations: DataFrame,
    fsp: DataFrame,
    population: DataFrame,
    segments: DataFrame,
    lights: DataFrame,
    customers: DataFrame,
    transformers: DataFrame,
    structures: DataFrame | None = None,
    meters: float = C.BUFFER_METERS,
) -> dict[str, DataFrame]:
    """All feature sets, each per customer or per customer and period, never per bill."""
    placed = locations.join(
        bills.select(F.col("nis_rad").alias("NIS_RAD")).distinct(), "NIS_RAD", "left_semi"
    )
    placed = placed.select(F.col("NIS_RAD").alias("nis_rad"), "LAT", "LON")
    sets = {
        "fsp": count_in_radius(placed, fsp, meters, by="factype", key="nis_rad", pivot=True),
        "population": population_features(bills, locations, population, meters),
        "roads": road_features(placed, segments, "both", key="nis_rad"),
        "nightlights": lights_features(bills, locations, lights, meters),
        "structures": electrified_structures(bills, customers, transformers, meters),
    }
    if structures is not None:
        total = count_in_radius(
            placed, structures, meters, shape="polygon", key="nis_rad", right_xy=("LON", "LAT")
        )
        sets["total_structs"] = total.withColumnRenamed("n", "total_structs")
    return sets


def analysis_columns(table: DataFrame) -> DataFrame:
    """The feature table under the names the panel analysis reads."""
    renamed = table.withColumnsRenamed(
        {old: new for old, new in ANALYSIS_NAMES.items() if old in table.columns}
    )
    derived = {}
    if "installation" in table.columns:
        derived["Year_of_connection"] = F.year("installation")
    if "period" in table.columns:
        derived["Month"] = dates.month(F.col("period"))
    if {"electrified_structures", "total_structs"} <= set(table.columns):
        derived["Electrification"] = F.try_divide("electrified_structures", "total_structs")
    return renamed.withColumns(derived) if derived else renamed


# Months of a customer that are filled together.
FILL_BLOCK = 64


def carry_forward(
    df: DataFrame,
    columns: Sequence[str],
    key: str = "nis_rad",
    time: str = "Nof_Mths",
    block: int = FILL_BLOCK,
) -> DataFrame:
    """Rows with the last known value of each column as of their time; NULL before the first.

    A key's rows are filled within blocks of `block` units of time. What a block does not know comes from a table with the
    last values of each block, so a long history is as many tasks as it has blocks, and only that
    table is ordered per key. Of rows with equal times any is the last.
    """
    blocked = df.withColumn("_b", F.floor(F.col(time) / block))
    inside = Window.partitionBy(key, "_b").orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    ends = blocked.groupBy(key, "_b").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(time))).alias(c) for c in columns]
    )
    earlier = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    known = ends.select(key, "_b", *[F.last(c, ignorenulls=True).over(earlier).alias(f"_e_{c}") for c in columns])
    filled = blocked.withColumns({c: F.last(c, ignorenulls=True).over(inside) for c in columns})
    joined = null_safe_join(filled, known, [key, "_b"])
    return joined.withColumns({c: F.coalesce(c, f"_e_{c}") for c in columns}).select(*df.columns)


def tenure_panel(
    table: DataFrame, features: Sequence[str], outcome: str = "csmo_fact", key: str = "nis_rad"
) -> DataFrame:
    """The feature table as a panel under the names of the analysis: one row per customer and month of tenure.

    Bills of a month are added up. Every month from a customer's first bill to the last is there; one without a bill has
    no consumption and the features known last. Bills before the connection, or without a date of it, are left out.
    """
    time = "months_since_connection"
    named = [c for c in ("installation", "period", "LAT", "LON", "rural_urban") if c in table.columns]
    billed = table.filter(F.col(time) >= 0)
    months = billed.groupBy(key, time).agg(
        F.sum(outcome).alias(outcome), *[F.max(c).alias(c) for c in dict.fromkeys([*named, *features])]
    )
    span = months.groupBy(F.col(key).alias("_key")).agg(F.min(time).alias("_lo"), F.max(time).alias("_hi"))
    every = span.select("_key", F.explode(F.sequence("_lo", "_hi")).alias("_month"))
    same = (F.col("_key") == F.col(key)) & (F.col("_month") == F.col(time))
    rows = every.join(months, same, "left").select(
        F.col("_key").alias(key), F.col("_month").alias(time), *[c for c in months.columns if c not in (key, time)]
    )
    carried = [c for c in months.columns if c not in (key, time, outcome, "period")]
    return analysis_columns(carry_forward(rows, carried, key, time))
