"""Customer segments: summaries, tiers, reports and dummy curves."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridpanel import constants as C
from gridpanel.operators.growth import growth_curve
from gridpanel.operators.order_stats import (
    exact_quantiles,
    grouped_statistics,
    quantiles_of_counts,
    value_counts,
)
from gridpanel.session import written


def consumption_summary(df: DataFrame, by: str = "nis_rad", value: str = "csmo_fact") -> DataFrame:
    """Mean, median, sample deviation and count per group; NULL groups are left out."""
    stats = {"Mean_Kwh": "mean", "Std_Kwh": "std", "Count": "count"}
    rows = df.filter(F.col(by).isNotNull())
    table = grouped_statistics(rows, value, [by], {"Median_Kwh": 0.5}, stats)
    return table.select(by, "Mean_Kwh", "Median_Kwh", "Std_Kwh", "Count")


def customer_statistics(df: DataFrame, by: str = "nis_rad", value: str = "csmo_fact") -> DataFrame:
    """Mean, median, maximum, minimum, sample deviation and count per customer."""
    stats = {"Mean": "mean", "Max": "max", "Min": "min", "Std": "std", "Count": "count"}
    rows = df.filter(F.col(by).isNotNull())
    table = grouped_statistics(rows, value, [by], {"Median": 0.5}, stats)
    return table.select(by, "Mean", "Median", "Max", "Min", "Std", "Count")


def consumption_tiers(
    summary: DataFrame,
    cuts: Sequence[float] = (0.33, 0.67),
    value: str = "Mean_Kwh",
    out: str = "segment",
) -> DataFrame:
    """Low up to the first cut, Medium up to the second, else High; NULL stays NULL.

    The summary and its limits are written when this is called: quantiles name their input several times, so those of
    quantiles of a summary that itself consists of quantiles would make a plan that grows with the product of all.
    """
    summary = written(summary)
    limits = written(exact_quantiles(summary, value, {"c0": cuts[0], "c1": cuts[1]}))
    limits = limits.select(F.struct("c0", "c1").alias("cuts")).scalar()
    tier = (
        F.when(F.col(value) <= limits["c0"], "Low")
        .when(F.col(value) <= limits["c1"], "Medium")
        .when(F.col(value) > limits["c1"], "High")
    )
    return summary.withColumn(out, tier)


def label_bills(bills: DataFrame, labels: DataFrame, label: str = "segment") -> DataFrame:
    """Bills of labelled customers, once per label; NULL labels are left out."""
    side = (
        labels.filter(F.col(label).isNotNull())
        .select(F.col("nis_rad").alias("_key"), label)
        .dropDuplicates()
    )
    return bills.join(side, F.col("nis_rad") == F.col("_key")).drop("_key")


def segment_report(
    bills: DataFrame, labels: DataFrame, label: str = "segment", value: str = "csmo_fact"
) -> DataFrame:
    """Customers (all labelled), bills, mean and median per segment that has bills."""
    rows = label_bills(bills, labels, label)
    stats = grouped_statistics(
        rows,
        value,
        [label],
        {"median_consumption": 0.5},
        {"bill_count": "rows", "avg_consumption": "mean"},
    )
    customers = (
        labels.filter(F.col(label).isNotNull())
        .groupBy(label)
        .agg(F.count(F.lit(1)).alias("customer_count"))
    )
    return stats.join(customers, label).select(
        label, "customer_count", "bill_count", "avg_consumption", "median_consumption"
    )


def segment_growth(
    bills: DataFrame,
    labels: DataFrame,
    label: str = "segment",
    min_count: int | None = None,
    max_months: int | None = None,
) -> DataFrame:
    """Growth curve of every segment; `min_count` is the least number of bills a month needs."""
    rows = label_bills(bills, labels, label)
    if max_months is not None:
        rows = rows.filter(F.col("Nof_Mths") <= max_months)
    return growth_curve(rows, [label, "Nof_Mths"], min_count=min_count)


def cluster_growth(bills: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """Growth curve per cluster of the k-cluster solution, named SC<label>."""
    named = labels.filter(F.col("k") == k).select(
        "nis_rad", F.concat(F.lit("SC"), F.col("label").cast("string")).alias("segment")
    )
    return segment_growth(bills, named)


def resolve_dummy(df: DataFrame, name: str) -> str:
    """Column behind a dummy name, which may be one of the short names."""
    return name if name in df.columns else C.DUMMY_ALIASES.get(name, name)


def dummy_curve(
    df: DataFrame,
    dummy: str,
    location: str | None = None,
    max_months: int = C.MAX_MONTHS_PLOT,
    by_location: bool = False,
) -> DataFrame:
    """Median consumption and rows by dummy level and month, optionally per location."""
    column = resolve_dummy(df, dummy)
    rows = df.filter(F.col("Nof_Mths") < max_months)
    if location is not None:
        rows = rows.filter(F.col("rural_urban") == location)
    by = (["rural_urban"] if by_location else []) + [column, "Nof_Mths"]
    if by_location:
        rows = rows.filter(F.col("rural_urban").isin("Rural", "Urban"))
    return grouped_statistics(rows, "csmo_fact", by, {"med": 0.5}, {"count": "rows"}).select(
        *by, "med", "count"
    )


def combined_dummy(dummy1: str, dummy2: str, level1: Column, level2: Column) -> Column:
    """Levels of two dummies in one label, names cut at their first underscore."""
    short1, short2 = dummy1.split("_")[0], dummy2.split("_")[0]
    known = level1.isin("Low", "High") & level2.isin("Low", "High")
    return F.when(
        known, F.concat(level1, F.lit(f"_{short1}_"), level2, F.lit(f"_{short2}"))
    )


def interaction_curves(
    df: DataFrame,
    dummies: Sequence[str] = C.DUMMY_PLOT_ORDER,
    max_months: int = C.MAX_MONTHS_PLOT,
    locations: Sequence[str] = ("Rural", "Urban"),
) -> DataFrame:
    """Median by combined level and month for all pairs of dummies, per location."""
    rows = df.filter(
        (F.col("Nof_Mths") < max_months) & F.col("rural_urban").isin(*locations)
    )
    levels = []
    for d1, d2 in combinations(dummies, 2):
        label = combined_dummy(d1, d2, F.col(resolve_dummy(df, d1)), F.col(resolve_dummy(df, d2)))
        pair = d1.replace("_dummy", "") + "_" + d2.replace("_dummy", "")
        levels.append(F.struct(F.lit(pair).alias("pair"), label.alias("dummy_comb")))
    # Equal rows are counted before they are copied once per pair.
    needed = sorted({resolve_dummy(df, d) for d in dummies})
    keys = ["rural_urban", "Nof_Mths", *needed]
    counted = value_counts(rows, "csmo_fact", keys)
    exploded = counted.select(
        "rural_urban", "Nof_Mths", "csmo_fact", "n", F.inline(F.array(*levels))
    )
    by = ["pair", "rural_urban", "dummy_comb", "Nof_Mths"]
    merged = exploded.groupBy(*by, "csmo_fact").agg(F.sum("n").alias("n"))
    return quantiles_of_counts(merged, "csmo_fact", {"med": 0.5}, by)
