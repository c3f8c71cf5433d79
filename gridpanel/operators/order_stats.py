"""Exact order statistics that never hold a large group in one task.

Rows are counted by (group, value) with map-side combination, so repeated values cost one row;
sums, means, deviations and extremes come from the same counts. Ranks are found by radix selection: a double
becomes a long in the same order, and counts are added up by its leading bits, the first 16 of all values
(TOP), then 12 more (FINE). Digits are passed over by their counts, and only within those that hold a
wanted rank are values sorted. Digits of more than FULL different values are counted once more by their next
18 bits first, so that at most 2 ** 18 rows are ever sorted together, however close the values lie; where no digit
is that full, the last step has no rows and adaptive execution leaves it out. There is one path for groups of all
sizes, and nothing runs before the result is asked for.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Bits of a key below each digit: of 16 bits, 12, 18, and values themselves.
TOP, FINE, LAST = 48, 36, 18
# Different values of one digit that are sorted together.
FULL = 1 << 16


def null_safe_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left", merge: bool = False
) -> DataFrame:
    """Equi-join in which NULL keys match each other; keys of the left side are kept.

    `merge` keeps both sides from being broadcast. Before a count has run, Spark takes its size from that of the
    compressed columns it reads, which may be a tenth of its rows and less.
    """
    renamed = right.withColumnsRenamed({c: f"_r_{c}" for c in on})
    condition = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on]
    joined = left.join(renamed.hint("merge") if merge else renamed, reduce(Column.__and__, condition), how)
    return joined.drop(*[f"_r_{c}" for c in on])


def value_counts(df: DataFrame, value: str, by: Sequence[str] = (), keep_missing: bool = False) -> DataFrame:
    """Rows per (group, value) as `n`; NULL and NaN count as missing."""
    number = F.col(value).cast("double")
    counts = (
        df.select(*by, F.when(~F.isnan(number), number + 0.0).alias(value))
        .groupBy(*by, value)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return counts if keep_missing else counts.filter(F.col(value).isNotNull())


def order_key(value: Column) -> Column:
    """The double as a long in the same order: its bits, negative for negative values."""
    size = F.abs(value)
    near = F.least(F.floor(F.log2(size)).cast("double"), F.lit(1023.0))
    # The logarithm is rounded, the powers of two it is put right by are not.
    power = (
        near
        - F.when(F.pow(F.lit(2.0), near) > size, 1).otherwise(0)
        + F.when(F.pow(F.lit(2.0), near + 1) <= size, 1).otherwise(0)
    )
    share = (size / F.pow(F.lit(2.0), power) - 1) * float(1 << 52)
    bits = (
        F.when(size == float("inf"), F.lit(2047 << 52))
        .when(size < 2.0**-1022, (size * 2.0**537 * 2.0**537).cast("long"))
        .otherwise((power + 1023).cast("long") * F.lit(1 << 52) + share.cast("long"))
    )
    return F.when(value < 0, -bits).otherwise(bits)


def _anchor(at: Column) -> Column:
    """A value near those of a digit, from its number alone."""
    key = F.least(F.abs(at), F.lit(2000 << (52 - FINE)))
    power = F.shiftright(key, 52 - FINE) - 1023
    share = key.bitwiseAND(F.lit((1 << (52 - FINE)) - 1)) / float(1 << (52 - FINE))
    size = (1 + share) * F.pow(F.lit(2.0), power.cast("double"))
    return F.when(at < 0, -size).otherwise(size)


def _holds(start: Column, n: Column, wanted: Mapping[str, Column] | None) -> Column:
    """Whether one of the wanted ranks is among `n` rows behind the first `start`."""
    if wanted is None:
        return F.lit(True)
    return reduce(Column.__or__, [(start <= rank) & (rank < start + n) for rank in wanted.values()])


def _ranges(counts: DataFrame, by: Sequence[str], wanted: Mapping[str, Column] | None) -> DataFrame:
    """Per (group, digit `_at`): rows, different values, rows before it, and the group's statistics on every row.

    Rows without a value are a digit of their own, `_at` NULL, that holds no rank; it is only kept for
    a group without any values.
    """
    n, off = F.col("n"), F.col("_v") - _anchor(F.col("_at"))
    fine = counts.groupBy(*by, "_top", "_at").agg(
        F.sum("n").alias("_all"),
        F.count("_v").alias("_distinct"),
        F.min("_v").alias("_lo"),
        F.max("_v").alias("_hi"),
        # Around a value of the digit, squares and sums do not cancel.
        F.sum(n * off).alias("_d"),
        F.sum(n * off * off).alias("_q"),
    )
    known = F.col("_at").isNotNull()
    fine = fine.withColumns(
        {
            "_in": F.when(known, F.col("_all")).otherwise(0),
            "_m": F.when(known, _anchor(F.col("_at")) + F.col("_d") / F.col("_all")),
            "_s": F.col("_q") - F.col("_d") * F.col("_d") / F.col("_all"),
        }
    )
    inside = Window.partitionBy(*by, "_top")
    earlier = inside.orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    fine = fine.withColumns(
        {
            "_within": F.coalesce(F.sum("_in").over(earlier), F.lit(0)),
            "_middle": F.try_divide(F.sum(F.col("_m") * F.col("_in")).over(inside), F.sum("_in").over(inside)),
        }
    )
    away = F.col("_m") - F.col("_middle")
    top = fine.groupBy(*by, "_top").agg(
        F.sum("_all").alias("_all"),
        F.sum("_in").alias("_in"),
        F.min("_lo").alias("_lo"),
        F.max("_hi").alias("_hi"),
        F.max("_middle").alias("_m"),
        F.sum(F.col("_s") + F.col("_in") * away * away).alias("_s"),
    )
    group = Window.partitionBy(*by)
    earlier = group.orderBy(F.col("_top").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    top = top.withColumns(
        {
            "_first": F.coalesce(F.sum("_in").over(earlier), F.lit(0)),
            "rows": F.sum("_all").over(group),
            "total": F.sum("_in").over(group),
            "min": F.min("_lo").over(group),
            "max": F.max("_hi").over(group),
        }
    )
    top = top.withColumn("mean", F.try_divide(F.sum(F.col("_m") * F.col("_in")).over(group), F.col("total")))
    away = F.col("_m") - F.col("mean")
    squares = F.sum(F.col("_s") + F.col("_in") * away * away).over(group)
    top = top.withColumn(
        "std",
        F.when(F.col("total") > 1, F.sqrt(F.greatest(squares, F.lit(0.0)) / (F.col("total") - 1))),
    )
    none = F.col("_top").isNull() & (F.col("total") == 0) if wanted is not None else F.lit(False)
    top = top.filter(none | (F.col("_top").isNotNull() & _holds(F.col("_first"), F.col("_in"), wanted)))
    top = top.select(*by, "_top", "_first", *STATISTICS)
    fine = fine.select(*by, "_top", "_at", "_in", "_distinct", "_within")
    both = null_safe_join(fine, top, [*by, "_top"], "inner", merge=True).withColumn("_before", F.col("_first") + F.col("_within"))
    return both.filter(F.col("_at").isNull() | _holds(F.col("_before"), F.col("_in"), wanted)).drop(
        "_top", "_first", "_within"
    )


STATISTICS = ("rows", "total", "mean", "std", "min", "max")


def _split(counts: DataFrame, full: DataFrame, by: Sequence[str], wanted: Mapping[str, Column] | None) -> DataFrame:
    """The digits of 18 more bits, `_at`, within full ones, with the same columns."""
    kids = null_safe_join(counts, full.drop("_in", "_distinct"), [*by, "_at"], "inner", merge=True)
    kids = kids.groupBy(*by, "_at", F.shiftright("_key", LAST).alias("_next")).agg(
        F.sum("n").alias("_in"), *[F.max(c).alias(c) for c in ("_before", *STATISTICS)]
    )
    earlier = Window.partitionBy(*by, "_at").orderBy("_next").rowsBetween(Window.unboundedPreceding, -1)
    kids = kids.withColumn("_before", F.col("_before") + F.coalesce(F.sum("_in").over(earlier), F.lit(0)))
    kids = kids.filter(_holds(F.col("_before"), F.col("_in"), wanted))
    return kids.drop("_at").withColumnRenamed("_next", "_at")


def _located(
    counts: DataFrame, value: str, by: Sequence[str], wanted: Mapping[str, Column] | None
) -> DataFrame:
    """Value counts (by, _v, n) with rows up to each value as `cum` and the group's statistics.

    With `wanted`, numbers of rows counted from 0 in terms of `total`, only the digits
    that hold one of them are kept, and a group without values keeps a row.
    """
    by = list(by)
    counts = counts.select(*by, F.col(value).alias("_v"), "n").withColumn("_key", order_key(F.col("_v")))
    counts = counts.withColumns({"_top": F.shiftright("_key", TOP), "_at": F.shiftright("_key", FINE)})
    ranges = _ranges(counts, by, wanted)
    full = F.col("_distinct") > FULL

    def summed(counts: DataFrame, digits: DataFrame) -> DataFrame:
        digits = digits.select(*by, "_at", "_before", *STATISTICS)
        kept = null_safe_join(counts.drop("_top", "_key"), digits, [*by, "_at"], "inner", merge=True)
        within = Window.partitionBy(*by, "_at").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
        return kept.withColumn("cum", F.col("_before") + F.sum("n").over(within)).select(
            *by, "_v", "n", "cum", *[F.col(s).alias(f"_{s}") for s in STATISTICS]
        )

    last = counts.withColumn("_at", F.shiftright("_key", LAST))
    return summed(counts, ranges.filter(~full)).unionByName(
        summed(last, _split(counts, ranges.filter(full), by, wanted))
    )


def cumulative_counts(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """One row per (group, value): rows `n`, rows up to the value `cum`, rows `total`."""
    located = _located(value_counts(df, value, by), value, by, None)
    return located.select(*by, F.col("_v").alias(value), "n", "cum", F.col("_total").alias("total"))


def exact_quantiles(
    df: DataFrame, value: str, probs: Mapping[str, float], by: Sequence[str] = ()
) -> DataFrame:
    """Linearly interpolated quantiles per group; groups without values give no row.

    `probs` maps output names to probabilities in [0, 1].
    """
    return quantiles_of_counts(value_counts(df, value, by), value, probs, by)


def quantiles_of_counts(
    counts: DataFrame,
    value: str,
    probs: Mapping[str, float],
    by: Sequence[str] = (),
    stats: Mapping[str, str] | None = None,
) -> DataFrame:
    """The same from (by, value, n), with statistics as in `grouped_statistics`."""
    by = list(by)

    def ranks(total: Column) -> tuple[dict, dict, dict]:
        at = {name: F.lit(float(p)) * (total - 1) for name, p in probs.items()}
        return at, {k: F.floor(v) for k, v in at.items()}, {k: F.ceil(v) for k, v in at.items()}

    _, low, high = ranks(F.col("total"))
    kept = _located(counts, value, by, {**{f"l{k}": v for k, v in low.items()}, **{f"h{k}": v for k, v in high.items()}})
    _, low, high = ranks(F.col("_total"))
    picks = [F.min(F.when(F.col("cum") > low[name], F.col("_v"))).alias(f"_lo_{name}") for name in probs]
    picks += [F.min(F.when(F.col("cum") > high[name], F.col("_v"))).alias(f"_hi_{name}") for name in probs]
    # Each statistic is one number per group, so its maximum is itself.
    picked = kept.groupBy(*by).agg(*[F.max(f"_{s}").alias(f"_{s}") for s in STATISTICS], *picks)
    at, low, _ = ranks(F.col("_total"))
    lo, hi = (lambda n: F.col(f"_lo_{n}")), (lambda n: F.col(f"_hi_{n}"))
    # Equal neighbours need no interpolation, which would not be exact for infinite ones.
    out = [
        F.when(lo(n) == hi(n), lo(n)).otherwise(lo(n) + (hi(n) - lo(n)) * (at[n] - low[n])).alias(n)
        for n in probs
    ]
    names = {"count": "total"}
    extra = [F.col(f"_{names.get(kind, kind)}").alias(name) for name, kind in (stats or {}).items()]
    # Without groups this is a total aggregate, which yields one row of NULLs over nothing.
    return picked.select(*by, *extra, *out)


def grouped_statistics(
    df: DataFrame,
    value: str,
    by: Sequence[str],
    probs: Mapping[str, float],
    stats: Mapping[str, str],
) -> DataFrame:
    """Quantiles and other statistics per group, all from one count by (group, value).

    `stats` maps output names to rows, count, mean, std, min or max; `rows` counts rows without
    a value as well. Groups without values have NULL quantiles.
    """
    counts = value_counts(df, value, by, keep_missing=True)
    return quantiles_of_counts(counts, value, probs, by, stats)


def average_ranks(df: DataFrame, value: str, out: str) -> DataFrame:
    """(value, rank) with ties given their average rank."""
    return ranks_of_counts(value_counts(df, value), value, out)


def ranks_of_counts(counts: DataFrame, value: str, out: str) -> DataFrame:
    """The same from (value, n)."""
    cum = _located(counts.filter(F.col(value).isNotNull()), value, [], None)
    rank = F.col("cum") - F.col("n") + (F.col("n") + 1) / 2.0
    return cum.select(F.col("_v").alias(value), rank.alias(out))


def smallest_by_hash(
    df: DataFrame,
    strata: Sequence[str],
    key: str,
    take: Column,
    seed: int,
    split_bits: int = 16,
) -> DataFrame:
    """Keep the `take` rows of every stratum whose key hashes lowest.

    Leading hash bits cut a stratum into equal parts. Parts beyond the cut are dropped
    by their counts, and rows are ranked within a part, never within a stratum.
    """
    hashed = df.withColumn("_h", F.xxhash64(F.col(key), F.lit(seed)))
    hashed = hashed.withColumn("_part", F.shiftright("_h", 64 - split_bits))
    parts = hashed.groupBy(*strata, "_part").agg(F.count(F.lit(1)).alias("_in"))
    order = Window.partitionBy(*strata).orderBy("_part")
    parts = parts.withColumn("_before", F.sum("_in").over(order) - F.col("_in"))
    joined = null_safe_join(hashed, parts, [*strata, "_part"], "inner")
    joined = joined.withColumn("_take", take).filter(F.col("_before") < F.col("_take"))
    rank = F.row_number().over(Window.partitionBy(*strata, "_part").orderBy("_h", key))
    kept = joined.withColumn("_rank", rank).filter(
        F.col("_before") + F.col("_rank") <= F.col("_take")
    )
    return kept.drop("_h", "_part", "_in", "_before", "_take", "_rank")
