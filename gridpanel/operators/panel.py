"""The billing panel: cleaning, sampling, dummies, merge and transformations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpanel import constants as C
from gridpanel.functions import scalars
from gridpanel.operators.cleaning import drop_keys
from gridpanel.operators.order_stats import exact_quantiles, smallest_by_hash

LOCATIONS = ("Urban", "Rural")


def prepare_panel(
    df: DataFrame, fsp_categories: Sequence[str] = C.FSP_CATEGORIES, key: str = "nis_rad"
) -> DataFrame:
    """Road distance in km, providers summed, gaps and negatives repaired, shares in percent.

    Customers with any electrification above 100 % are removed altogether.
    """
    present = [c for c in fsp_categories if c in df.columns]
    providers = F.lit(0.0)
    for c in present:
        providers = providers + F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    lights = F.col("Night_Lights")
    cleaned = df.withColumns(
        {
            "min_dist2_road": F.col("min_dist2_road") * C.KM_PER_DEGREE,
            "fsp": providers,
            "total_structs": F.coalesce("total_structs", F.lit(0.0)),
            "Night_Lights": F.when(lights < 0, 0.0).otherwise(lights),
            "Electrification": F.col("Electrification") * 100,
        }
    )
    invalid = cleaned.filter(F.col("Electrification") > 100).select(key).distinct()
    return drop_keys(cleaned, invalid, key)


def complete_customers(df: DataFrame) -> DataFrame:
    """(nis_rad, rural_urban, Year_of_connection) with no more than one missing month.

    Kept are groups with at least as many rows as months between first and last row.
    """
    spans = df.groupBy("nis_rad", "rural_urban", "Year_of_connection").agg(
        (F.max("Nof_Mths") - F.min("Nof_Mths")).alias("nof_M"),
        F.count(F.lit(1)).alias("count"),
    )
    return spans.filter(F.col("count") - F.col("nof_M") >= 0)


def stratum_targets(customers: DataFrame, size: int, rural_share: float) -> DataFrame:
    """Customers to draw per location and year: the year's share of the location's target.

    A stratum smaller than its share is not drawn from at all.
    """
    strata = customers.groupBy("rural_urban", "Year_of_connection").agg(
        F.count(F.lit(1)).alias("available")
    )
    totals = strata.groupBy("rural_urban").agg(F.sum("available").alias("total"))
    share = F.when(F.col("rural_urban") == "Rural", rural_share * size).when(
        F.col("rural_urban") == "Urban", (1 - rural_share) * size
    )
    weighted = strata.join(totals, "rural_urban").withColumn(
        "weight", F.col("available") / F.col("total")
    )
    target = F.bround(F.col("weight") * share).cast("long")
    return weighted.withColumn(
        "target", F.when(F.col("available") >= target, target).otherwise(0)
    ).drop("total")


def clamp_year(year: str, threshold: int, floor: int = C.FIRST_CONNECTION_YEAR):
    """Years before the threshold become the floor year."""
    return F.when(F.col(year) < threshold, F.lit(floor)).otherwise(F.col(year))


def balanced_sample(
    df: DataFrame,
    n: int = 30000,
    rural_share: float = C.RURAL_SHARE,
    seed: int = 1,
) -> DataFrame:
    """All rows of a sample of customers, stratified by location and year of connection.

    Drawn are the customers whose hashed id is lowest in their stratum, so the sample
    is the same on every run and every cluster.
    """
    rows = df.filter(F.col("GDP").isNotNull())
    customers = complete_customers(rows).filter(F.col("rural_urban").isin(*LOCATIONS))
    customers = customers.withColumn(
        "Year_of_connection", clamp_year("Year_of_connection", C.FIRST_CONNECTION_YEAR)
    )
    strata = ["rural_urban", "Year_of_connection"]
    targets = stratum_targets(customers, n, rural_share).select(*strata, "target")
    candidates = customers.join(targets, strata)
    drawn = smallest_by_hash(candidates, strata, "nis_rad", F.col("target"), seed)
    return rows.join(drawn.select("nis_rad").distinct(), "nis_rad", "left_semi")


def median_dummies(df: DataFrame, variables: Sequence[str] = C.DUMMY_SOURCES) -> DataFrame:
    """`<variable>_dummy`: Low below the median of the row's own location, else High.

    The road distance is turned round: near is High. Rows of no known location and
    NULLs keep the default.
    """
    present = [v for v in variables if v in df.columns]
    if not present:
        return df
    rows = df.filter(F.col("rural_urban").isin(*LOCATIONS))
    long = scalars.to_long(rows, present, ["rural_urban"])
    medians = exact_quantiles(long, "value", {"m": 0.5}, ["rural_urban", "variable"])
    # Two locations: at most two rows.
    wide = medians.groupBy("rural_urban").pivot("variable", present).agg(F.first("m"))
    wide = wide.select("rural_urban", *[F.col(v).alias(f"_m_{v}") for v in present])
    joined = df.join(F.broadcast(wide), "rural_urban", "left")
    dummies = {}
    for v in present:
        below, rest = ("High", "Low") if v == "min_dist2_road" else ("Low", "High")
        dummies[f"{v}_dummy"] = F.when(F.col(v) < F.col(f"_m_{v}"), below).otherwise(rest)
    return joined.withColumns(dummies).select(*df.columns, *dummies)


def merge_gcp(df: DataFrame, gcp: DataFrame) -> DataFrame:
    """Inner join of the monthly product per customer, which takes over the name GDP."""
    rows = df.withColumn("Year_of_connection", clamp_year("Year_of_connection", 2010))
    if "GDP" in df.columns:
        rows = rows.withColumnRenamed("GDP", "GDP_annual")
    side = gcp.select("nis_rad", "Nof_Mths", F.col("GCP").try_cast("double").alias("GDP"))
    return rows.join(side.filter(F.col("GDP").isNotNull()), ["nis_rad", "Nof_Mths"])


def log_transform(
    df: DataFrame, variables: Sequence[str] = C.LOG_VARS, constant: float = C.LOG_CONSTANT
) -> DataFrame:
    return df.withColumns({v: scalars.log_plus(F.col(v), constant) for v in variables})


def standardize(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    exclude: Sequence[str] = ("nis_rad", "Nof_Mths", "Year_of_connection"),
) -> DataFrame:
    """Numeric columns to mean 0 and sample deviation 1, over all rows; constants to 0."""
    columns = list(columns or scalars.numeric_columns(df, exclude))
    moments = df.agg(
        F.struct(
            *[F.avg(c).alias(f"m_{c}") for c in columns],
            *[F.stddev_samp(c).alias(f"s_{c}") for c in columns],
        ).alias("m")
    )
    rows = df.withColumn("_m", moments.scalar())
    scaled = {}
    for c in columns:
        centred, spread = F.col(c) - F.col(f"_m.m_{c}"), F.col(f"_m.s_{c}")
        scaled[c] = F.when(spread > 0, centred / spread).otherwise(
            F.when(F.col(c).isNotNull(), 0.0)
        )
    return rows.withColumns(scaled).drop("_m")


def split_by_location(df: DataFrame) -> dict[str, DataFrame]:
    return {
        "urban": df.filter(F.col("rural_urban") == "Urban"),
        "rural": df.filter(F.col("rural_urban") == "Rural"),
        "combined": df,
    }


def demean_within(
    df: DataFrame, columns: Sequence[str] = C.TIME_VARYING_VARS, key: str = "nis_rad"
) -> DataFrame:
    """Each column minus its customer's mean, and the mean as `<column>_mean`."""
    means = cluster_means(df, columns, key)
    joined = df.join(means, key, "left")
    return joined.withColumns({c: F.col(c) - F.col(f"{c}_mean") for c in columns})


def cluster_means(
    df: DataFrame, columns: Sequence[str] = C.TIME_VARYING_VARS, key: str = "nis_rad"
) -> DataFrame:
    return df.groupBy(key).agg(*[F.avg(c).alias(f"{c}_mean") for c in columns])
