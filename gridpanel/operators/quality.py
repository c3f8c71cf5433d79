"""Data quality: panel structure, outliers, correlations, summaries, report."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpanel.functions import scalars
from gridpanel.operators.order_stats import grouped_statistics, quantiles_of_counts, ranks_of_counts
from gridpanel.session import written


def value_table(df: DataFrame, group: str | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """(group, variable, number, other, n): rows per value of every column, counted in one pass.

    Numbers are doubles in `number`, anything else is text in `other`; both are NULL where a value is missing. What a
    report says of single columns follows from this table alone. `group` is named `_group`.
    """
    numeric = set(scalars.numeric_columns(df))
    none = F.lit(None)
    cells = [
        F.struct(
            F.lit(c).alias("variable"),
            (F.col(f"`{c}`") if c in numeric else none).cast("double").alias("number"),
            (none if c in numeric else F.col(f"`{c}`")).cast("string").alias("other"),
        )
        for c in columns or df.columns
    ]
    by = (F.col(f"`{group}`") if group else none.cast("string")).alias("_group")
    return (
        df.select(by, F.inline(F.array(*cells)))
        .groupBy("_group", "variable", "number", "other")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _numbers(table: DataFrame, variables: Sequence[str], by: Sequence[str]) -> DataFrame:
    """(by, value, n) of some variables; NaN counts as missing."""
    value = F.when(~F.isnan("number"), F.col("number") + 0.0).alias("value")
    return table.filter(F.col("variable").isin(*variables)).groupBy(*by, value).agg(F.sum("n").alias("n"))


def validate_panel(
    df: DataFrame, id_col: str = "nis_rad", time_col: str = "Nof_Mths", table: DataFrame | None = None
) -> dict[str, DataFrame]:
    """Structure (one row), columns with gaps, and range of every numeric column.

    A missing id or time counts as one value; balanced means every id has every time. `table` is the
    value table, if it is there already.
    """
    if table is None:
        table = value_table(df)
    # Equal values of several groups are one value.
    values = table.groupBy("variable", "number", "other").agg(F.sum("n").alias("n"))
    per = values.groupBy("variable").agg(
        F.count(F.lit(1)).alias("distinct"),
        F.sum("n").alias("rows"),
        F.sum(F.when(F.col("number").isNull() & F.col("other").isNull(), F.col("n")).otherwise(0)).alias("missing_count"),
        F.min("number").alias("min"),
        F.max("number").alias("max"),
    )
    of = lambda name, value: F.coalesce(F.max(F.when(F.col("variable") == name, F.col(value))), F.lit(0))
    structure = per.agg(
        of(id_col, "distinct").alias("n_individuals"),
        of(time_col, "distinct").alias("n_time_periods"),
        of(id_col, "rows").alias("n_observations"),
    ).withColumn(
        "is_balanced",
        F.col("n_observations") == F.col("n_individuals") * F.col("n_time_periods"),
    )
    numeric = scalars.numeric_columns(df)
    return {
        "structure": structure,
        "missing": per.filter("missing_count > 0").select("variable", "missing_count"),
        "ranges": per.filter(F.col("variable").isin(*numeric)).select("variable", "min", "max"),
    }


def detect_outliers(
    df: DataFrame,
    variables: Sequence[str] | None = None,
    multiplier: float = 1.5,
    table: DataFrame | None = None,
) -> DataFrame:
    """Values beyond the quartiles by more than `multiplier` interquartile ranges.

    The rate is over all rows, those without a value included.
    """
    variables = list(variables or scalars.numeric_columns(df))
    if table is None:
        table = value_table(df, columns=variables)
    counts = _numbers(table, variables, ["variable"])
    quartiles = quantiles_of_counts(counts, "value", {"q1": 0.25, "q3": 0.75}, ["variable"])
    spread = multiplier * (F.col("q3") - F.col("q1"))
    fences = quartiles.select(
        "variable",
        (F.col("q1") - spread).alias("lower_bound"),
        (F.col("q3") + spread).alias("upper_bound"),
    )
    outside = (F.col("value") < F.col("lower_bound")) | (F.col("value") > F.col("upper_bound"))
    # One row of fences per variable.
    checked = counts.join(F.broadcast(fences), "variable", "left")
    beyond = F.sum(F.when(outside, F.col("n")).otherwise(0))
    return checked.groupBy("variable").agg(
        beyond.alias("n_outliers"),
        (beyond / F.sum("n")).alias("outlier_rate"),
        F.max("lower_bound").alias("lower_bound"),
        F.max("upper_bound").alias("upper_bound"),
    )


def summary_stats(
    df: DataFrame,
    group: str = "rural_urban",
    variables: Sequence[str] | None = None,
    table: DataFrame | None = None,
) -> DataFrame:
    """Mean, median, sample deviation, minimum and maximum per variable, and rows, by group."""
    variables = list(variables or scalars.numeric_columns(df, [group]))
    if table is None:
        table = value_table(df, group, variables)
    stats = {"mean": "mean", "sd": "std", "min": "min", "max": "max", "n": "rows"}
    counts = _numbers(table, variables, ["_group", "variable"])
    found = quantiles_of_counts(counts, "value", {"median": 0.5}, ["_group", "variable"], stats)
    # Every variable has all rows of a group, so any of them counts the group.
    wide = found.groupBy(F.col("_group").alias(group)).agg(
        *[
            F.max(F.when(F.col("variable") == v, F.col(s))).alias(f"{v}_{s}")
            for v in variables
            for s in ("mean", "median", "sd", "min", "max")
        ],
        F.max("n").alias("n"),
    )
    return wide


def correlations(
    df: DataFrame, variables: Sequence[str] | None = None, method: str = "pearson"
) -> DataFrame:
    """(var1, var2, correlation) over rows complete in all variables, strongest first.

    Both orders of a pair, without the diagonal; NULL where a variable is constant.
    """
    if method not in ("pearson", "spearman"):
        raise ValueError(f"unknown method: {method}")
    variables = list(variables or scalars.numeric_columns(df))
    rows = df.select(*[F.col(v).cast("double").alias(v) for v in variables]).dropna()
    pairs = list(combinations(variables, 2))
    if method == "spearman":
        measured = _rank_moments(rows, variables, pairs)
    else:
        measured = rows.agg(
            *[F.covar_pop(a, b).alias(f"_c{i}") for i, (a, b) in enumerate(pairs)],
            *[F.stddev_pop(v).alias(f"_s_{v}") for v in variables],
        )

    def entry(a: str, b: str, i: int):
        # Not `corr`, which fails on a constant column.
        r = F.try_divide(F.col(f"_c{i}"), F.col(f"_s_{a}") * F.col(f"_s_{b}"))
        return F.struct(
            F.lit(a).alias("var1"), F.lit(b).alias("var2"), r.alias("correlation")
        )

    both = [e for i, (a, b) in enumerate(pairs) for e in (entry(a, b, i), entry(b, a, i))]
    table = measured.select(F.inline(F.array(*both)))
    return table.orderBy(F.abs("correlation").desc_nulls_last(), "var1", "var2")


def _rank_moments(rows: DataFrame, variables: Sequence[str], pairs) -> DataFrame:
    """Covariances and deviations of the ranks; equal rows are counted before they are ranked."""
    counted = rows.groupBy(*variables).agg(F.count(F.lit(1)).alias("_n"))
    middle = counted.agg((F.sum("_n") + 1) / 2.0).scalar()
    ranked = counted
    for v in variables:
        counts = counted.groupBy(v).agg(F.sum("_n").alias("n"))
        # A row per different value, which no size read from the input's columns tells: never broadcast.
        ranked = ranked.join(ranks_of_counts(counts, v, f"_rank_{v}").hint("merge"), v)
    off = {v: F.col(f"_rank_{v}") - F.col("_middle") for v in variables}
    return ranked.withColumn("_middle", middle).agg(
        *[(F.sum(F.col("_n") * off[a] * off[b]) / F.sum("_n")).alias(f"_c{i}") for i, (a, b) in enumerate(pairs)],
        *[F.sqrt(F.sum(F.col("_n") * off[v] * off[v]) / F.sum("_n")).alias(f"_s_{v}") for v in variables],
    )


def correlation_matrix(long: DataFrame) -> DataFrame:
    """Square table of a long one, with ones on the diagonal."""
    names = [r[0] for r in long.select("var1").distinct().orderBy("var1").collect()]
    wide = long.groupBy("var1").pivot("var2", names).agg(F.first("correlation"))
    return wide.select(
        "var1",
        *[F.when(F.col("var1") == n, F.lit(1.0)).otherwise(F.col(n)).alias(n) for n in names],
    ).orderBy("var1")


def quality_report(df: DataFrame, group: str = "rural_urban") -> dict[str, DataFrame]:
    """Dimensions, panel validation, outliers, correlations, summaries and strong pairs.

    The input is read twice: once for the table of values, which is written to the checkpoint folder and which all
    parts but the correlations follow from, and once for these.
    """
    table = written(value_table(df, group))
    related = correlations(df)
    first = F.col("variable") == df.columns[0]
    return {
        "dimensions": table.agg(
            F.coalesce(F.sum(F.when(first, F.col("n"))), F.lit(0)).alias("rows"), F.lit(len(df.columns)).alias("columns")
        ),
        **{f"panel_{name}": part for name, part in validate_panel(df, table=table).items()},
        "outliers": detect_outliers(df, table=table),
        "correlations": related,
        "summary_stats": summary_stats(df, group, table=table),
        "high_correlations": related.filter(F.abs("correlation") > 0.7),
    }


def report_lines(report: dict[str, DataFrame]) -> DataFrame:
    """The report as text, one row per line in order (`section`, `position`, `line`)."""

    def lines(section: int, *parts) -> DataFrame:
        frame, texts = parts
        rows = [F.struct(F.lit(i).alias("position"), t.alias("line")) for i, t in enumerate(texts)]
        return frame.select(
            F.lit(section).alias("section"), F.lit(0.0).alias("weight"), F.inline(F.array(*rows))
        )

    def table(section: int, heading: str, frame: DataFrame, columns: Sequence[str]) -> DataFrame:
        """A heading and column names where the table has rows, and its rows, largest first."""
        shown = [F.format_string("%.6f", c) if kind == "double" else F.col(c).cast("string") for c, kind in frame.dtypes if c in columns]
        row = F.concat_ws(" ", *shown)
        body = frame.select(
            F.lit(section).alias("section"),
            F.abs(F.col(columns[-1]).cast("double")).alias("weight"),
            F.lit(2).alias("position"),
            row.alias("line"),
        )
        head = frame.agg(F.count(F.lit(1)).alias("n")).filter("n > 0")
        titles = lines(section, head, [F.lit(heading), F.lit(" ".join(columns))])
        return titles.unionByName(body)

    dimensions = report["dimensions"]
    top = lines(
        0,
        dimensions,
        [
            F.lit("Data Quality Report"),
            F.lit("=================="),
            F.lit(""),
            F.concat(
                F.lit("Data Dimensions: "),
                F.col("rows").cast("string"),
                F.lit(" rows x "),
                F.col("columns").cast("string"),
                F.lit(" columns"),
            ),
            F.lit(""),
        ],
    )
    structure = lines(
        1,
        report["panel_structure"],
        [
            F.lit("Panel Structure:"),
            F.concat(F.lit("- Individuals: "), F.col("n_individuals").cast("string")),
            F.concat(F.lit("- Time periods: "), F.col("n_time_periods").cast("string")),
            F.concat(F.lit("- Balanced: "), F.upper(F.col("is_balanced").cast("string"))),
            F.lit(""),
        ],
    )
    gaps = table(2, "Missing Data:", report["panel_missing"], ["variable", "missing_count"])
    strong = table(
        3,
        "High Correlations (|r| > 0.7):",
        report["high_correlations"],
        ["var1", "var2", "correlation"],
    )
    return (
        top.unionByName(structure)
        .unionByName(gaps)
        .unionByName(strong)
        .orderBy("section", "position", F.desc("weight"), "line")
        .select("section", "position", "line")
    )


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, sample deviation, minimum, quartiles and maximum, one row per column."""
    long = scalars.to_long(df, columns)
    table = grouped_statistics(
        long,
        "value",
        ["variable"],
        {"q25": 0.25, "q50": 0.5, "q75": 0.75},
        {name: name for name in ("count", "mean", "std", "min", "max")},
    )
    return table.select("variable", "count", "mean", "std", "min", "q25", "q50", "q75", "max")
