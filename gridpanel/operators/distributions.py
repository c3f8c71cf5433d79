"""Distribution tables: cumulative distributions, histograms, customer means."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpanel.operators.order_stats import cumulative_counts, null_safe_join

ECDF_VARS = (
    "total_structs",
    "population",
    "fsp",
    "min_dist2_road",
    "Electrification",
    "Night_Lights",
)


def ecdf(
    df: DataFrame,
    column: str,
    by: str | None = None,
    denominator: str = "all",
    upto: float | None = None,
) -> DataFrame:
    """(by, value, cdf): share of rows up to each distinct value.

    `denominator='all'` counts rows without a value as well, so the curve may end below
    1; 'non_null' does not. Rows without a group are left out. `upto` cuts the curve.
    """
    if denominator not in ("all", "non_null"):
        raise ValueError(f"unknown denominator: {denominator}")
    groups = [by] if by else []
    rows = df.filter(F.col(by).isNotNull()) if by else df
    rows = rows.select(*groups, F.col(column).cast("double").alias("value"))
    cum = cumulative_counts(rows, "value", groups)
    if denominator == "all":
        sizes = rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("_all"))
        cum = cum.join(sizes, by) if by else cum.withColumn("_all", sizes.scalar())
        share = F.col("cum") / F.col("_all")
    else:
        share = F.col("cum") / F.col("total")
    out = cum.select(*groups, "value", share.alias("cdf"))
    return out if upto is None else out.filter(F.col("cdf") <= upto)


def customer_means(
    df: DataFrame, variables: Sequence[str] = ECDF_VARS, key: str = "nis_rad", order: str = "Nof_Mths"
) -> DataFrame:
    """Mean of each variable and first location per customer."""
    return df.groupBy(key).agg(
        *[F.avg(v).alias(v) for v in variables],
        F.min_by("rural_urban", order).alias("rural_urban"),
    )


def histogram(df: DataFrame, column: str, bins: int = 30, by: str | None = None) -> DataFrame:
    """(by, bin, low, high, count) over equal bins shared by all groups, empty ones included.

    Bins are (max - min) / (bins - 1) wide, closed on the right and centred on
    multiples of their width.
    """
    groups = [by] if by else []
    rows = df.select(*groups, F.col(column).cast("double").alias("_v"))
    rows = rows.filter(F.col("_v").isNotNull())
    width = (F.max("_v") - F.min("_v")) / (bins - 1)
    span = rows.agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"), width.alias("w"))
    # Values that are all equal share one bin of width 1.
    span = span.withColumn("w", F.when(F.col("w") > 0, F.col("w")).otherwise(1.0))
    first = (F.floor(F.col("lo") / F.col("w") - 0.5) + 0.5) * F.col("w")
    span = span.select(F.struct("lo", "hi", "w", first.alias("origin")).alias("s"))

    def bin_of(value):
        at = F.ceil((value - F.col("_s.origin")) / F.col("_s.w")) - 1
        return F.greatest(at, F.lit(0))

    placed = rows.withColumn("_s", span.scalar()).select(
        *groups, bin_of(F.col("_v")).alias("bin")
    )
    counts = placed.groupBy(*groups, "bin").agg(F.count(F.lit(1)).alias("count"))
    heads = rows.select(*groups).distinct() if by else rows.agg(F.lit(1).alias("_one"))
    frame = heads.withColumn("_s", span.scalar())
    frame = frame.select(
        *groups, "_s", F.explode(F.sequence(F.lit(0).cast("long"), bin_of(F.col("_s.hi")))).alias("bin")
    )
    joined = null_safe_join(frame, counts, [*groups, "bin"])
    low = F.col("_s.origin") + F.col("bin") * F.col("_s.w")
    return joined.select(
        *groups,
        "bin",
        low.alias("low"),
        (low + F.col("_s.w")).alias("high"),
        F.coalesce("count", F.lit(0)).alias("count"),
    )
