"""Exponential decay fitted to consumption over time."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridpanel.functions.scalars import exponential_decay
from gridpanel.operators.order_stats import null_safe_join

# Rates tried at first, in multiples of one over the group's range of x.
RATES = sorted([*np.geomspace(1e-2, 700, 48), *(-np.geomspace(1e-2, 30, 16))])
# Beyond them rates grow by the same factor, up to those for which one gap of x is all there is to see.
GROWTH = (700 / 1e-2) ** (1 / 47)
LAST = 40.0
# Every round divides the bracket around the best rate into so many steps.
STEPS = 64
# Brackets shrink by 32 each round, from about a quarter of the rate to a billionth of it.
ROUNDS = 6

UPPER = [(i, j) for i in range(3) for j in range(i, 3)]
AT = ("a", "b", "c")


def _points(df: DataFrame, x: str, y: str, by: Sequence[str]) -> DataFrame:
    """(group, _x, _n, _y, _spread): rows with equal x added up."""
    rows = df.select(*by, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_v"))
    rows = rows.filter(F.col("_x").isNotNull() & F.col("_v").isNotNull())
    return rows.groupBy(*by, "_x").agg(
        F.count(F.lit(1)).alias("_n"),
        F.avg("_v").alias("_y"),
        # Squares around the mean of each x stay in the residual of any curve.
        F.coalesce(F.var_pop("_v") * F.count(F.lit(1)), F.lit(0.0)).alias("_spread"),
    )


def _placed(points: DataFrame, by: Sequence[str]) -> DataFrame:
    """Points with their group's first and last x, `_x0` and `_x1`, and the gaps beside them, `_g0` and `_g1`."""
    ends = null_safe_join(
        points, points.groupBy(*by).agg(F.min("_x").alias("_x0"), F.max("_x").alias("_x1")), by, "inner"
    )
    gaps = ends.groupBy(*by).agg(
        F.max("_x0").alias("_x0"),
        F.max("_x1").alias("_x1"),
        (F.min(F.when(F.col("_x") > F.col("_x0"), F.col("_x"))) - F.max("_x0")).alias("_g0"),
        (F.max("_x1") - F.max(F.when(F.col("_x") < F.col("_x1"), F.col("_x")))).alias("_g1"),
    )
    return null_safe_join(points, gaps, by, "inner")


def _best(tried: DataFrame, by: Sequence[str], carried: Sequence[str] = ()) -> DataFrame:
    """(group, n, _m, a, b, c, carried): the best of the tried rates `_b`; for a given rate the rest is linear."""
    n, e, y = F.col("_n"), F.col("_e"), F.col("_y")
    # Exponentials are 1 where they are largest, so that none of them overflows and not all vanish.
    origin = F.when(F.col("_b") > 0, F.col("_x0")).otherwise(F.col("_x1"))
    sums = (
        tried.withColumn("_o", origin)
        .withColumn("_e", F.exp(-F.col("_b") * (F.col("_x") - F.col("_o"))))
        .groupBy(*by, "_b")
        .agg(
            F.sum(n).alias("n"),
            F.sum(n * e).alias("e"),
            F.sum(n * e * e).alias("ee"),
            F.sum(n * y).alias("y"),
            F.sum(n * e * y).alias("ey"),
            F.max("_o").alias("_o"),
            *[F.max(c).alias(c) for c in carried],
        )
    )
    spread = F.col("ee") - F.col("e") * F.col("e") / F.col("n")
    usable = _finite(spread) & (spread > 1e-12 * F.col("ee"))
    a = F.try_divide(F.col("ey") - F.col("e") * F.col("y") / F.col("n"), spread)
    fit = F.struct(
        (a * a * spread).alias("gain"),
        (a * F.exp(F.col("_b") * F.col("_o"))).alias("a"),
        F.col("_b").alias("b"),
        ((F.col("y") - a * F.col("e")) / F.col("n")).alias("c"),
    )
    best = sums.groupBy(*by).agg(
        F.max("n").alias("n"),
        F.max(F.col("y") / F.col("n")).alias("_m"),
        F.max(F.when(usable, fit)).alias("_t"),
        *[F.max(c).alias(c) for c in carried],
    )
    return best.select(*by, "n", "_m", *[F.col(f"_t.{p}").alias(p) for p in AT], *carried)


def _beyond(rate: float, gap: str) -> Column:
    """Rates that go on from `rate` over the range by GROWTH, until LAST over the gap."""
    span = F.col("_x1") - F.col("_x0")
    more = F.ceil(F.log(F.greatest(LAST * span / (abs(rate) * F.col(gap)), F.lit(1.0))) / float(np.log(GROWTH)))
    steps = F.when(more > 0, F.sequence(F.lit(1), more.cast("int")))
    return F.coalesce(F.transform(steps, lambda i: rate / span * F.pow(F.lit(GROWTH), i)), F.array().cast("array<double>"))


def _bracketed(points: DataFrame, by: Sequence[str]) -> DataFrame:
    """The best of the first rates, and its neighbours `_lo` and `_hi`; NULL beyond the first and last rate."""
    span = F.greatest(F.col("_x1") - F.col("_x0"), F.lit(1e-12))
    rates = F.concat(
        F.array(*[F.lit(float(r)) / span for r in RATES]), _beyond(RATES[-1], "_g0"), _beyond(RATES[0], "_g1")
    )
    around = ["_x0", "_x1", "_g0", "_g1"]
    best = _best(points.withColumn("_b", F.explode(rates)), by, around)
    return best.withColumns(
        {
            "_lo": F.array_max(F.filter(rates, lambda r: r < F.col("b"))),
            "_hi": F.array_min(F.filter(rates, lambda r: r > F.col("b"))),
        }
    ).drop(*around)


def _narrowed(points: DataFrame, state: DataFrame, by: Sequence[str]) -> DataFrame:
    """The best rate inside each group's bracket, with the bracket around it."""
    width = (F.col("_hi") - F.col("_lo")) / STEPS
    rates = F.transform(F.sequence(F.lit(0), F.lit(STEPS)), lambda i: F.col("_lo") + i * width)
    joined = null_safe_join(points, state.select(*by, "_lo", "_hi"), by, "inner")
    best = _best(joined.withColumn("_b", F.explode(F.coalesce(rates, F.array(F.lit(1.0))))), by, ["_lo", "_hi"])
    return best.withColumns(
        {
            "_lo": F.greatest(F.col("_lo"), F.col("b") - width),
            "_hi": F.least(F.col("_hi"), F.col("b") + width),
        }
    )


def _finite(value: Column) -> Column:
    return F.coalesce(~F.isnan(value) & (F.abs(value) < float("inf")), F.lit(False))


def _normal_equations(points: DataFrame, fits: DataFrame, by: Sequence[str]) -> DataFrame:
    """J'J, and squares of the residuals and of the fitted values around the mean, of every group."""
    at = fits.select(*by, "_m", *[F.col(p).alias(f"_{p}") for p in AT])
    placed = null_safe_join(points, at, by, "inner")
    n, x = F.col("_n"), F.col("_x")
    slope = F.exp(-F.col("_b") * x)
    fitted = exponential_decay(x, F.col("_a"), F.col("_b"), F.col("_c"))
    jacobian = [slope, -F.col("_a") * x * slope, F.lit(1.0)]
    off, around = F.col("_y") - fitted, fitted - F.col("_m")
    return placed.groupBy(*by).agg(
        *[F.sum(n * jacobian[i] * jacobian[j]).alias(f"h{i}{j}") for i, j in UPPER],
        F.sum(n * off * off + F.col("_spread")).alias("ss"),
        F.sum(n * around * around).alias("total"),
    )


def _inverse() -> dict[tuple[int, int], Column]:
    """Inverse of J'J, scaled to a unit diagonal first."""
    scale = [F.sqrt(F.greatest(F.col(f"h{i}{i}"), F.lit(1e-300))) for i in range(3)]
    m = {}
    for i, j in UPPER:
        m[i, j] = m[j, i] = F.col(f"h{i}{j}") / (scale[i] * scale[j])
    others = {0: (1, 2), 1: (0, 2), 2: (0, 1)}
    adjugate = {}
    for i in range(3):
        for j in range(3):
            (r, s), (p, q) = others[j], others[i]
            minor = m[r, p] * m[s, q] - m[r, q] * m[s, p]
            adjugate[i, j] = minor if (i + j) % 2 == 0 else -minor
    determinant = reduce(Column.__add__, [m[0, j] * adjugate[j, 0] for j in range(3)])
    return {(i, j): F.try_divide(adjugate[i, j], determinant * scale[i] * scale[j]) for i, j in UPPER}


def fit_decay(
    df: DataFrame, x: str = "Nof_Mths", y: str = "csmo_fact", by: Sequence[str] = ()
) -> DataFrame:
    """a * exp(-b x) + c by least squares, per group.

    For a given rate b the rest is a line, so only b is searched: first over rates of both signs, from
    a hundredth of one over the group's range of x to forty over its first (for growth, last) gap, then six times within the bracket around the best, which leaves a billionth of it. (A
    library fitter would start at 1, 1, 1 and may end in another local minimum.) Rows with equal
    x are added up first; each round is one aggregate for all groups, whose brackets are rows of
    a table, and nothing runs before the result is asked for. One row per group: a, b, c, their
    covariance as cov_aa .. cov_cc, r_squared, n and `converged`. The total squares of r_squared
    are those of the fitted values around the mean of the data. Where the best rate is the first
    or the last of all, as for values that do not depend on x, there is no fit: NULLs, and
    `converged` is false.
    """
    keys = list(by) or ["_all"]
    points = _placed(_points(df if by else df.withColumn("_all", F.lit(1)), x, y, keys), keys)
    state = _bracketed(points, keys)
    for _ in range(ROUNDS):
        state = _narrowed(points, state, keys)
    fits = null_safe_join(state, _normal_equations(points, state, keys), keys)
    noise = F.try_divide(F.col("ss"), F.col("n") - 3)
    covariance = {f"cov_{AT[i]}{AT[j]}": v * noise for (i, j), v in _inverse().items()}
    # Three points leave no residual, and equal columns of the Jacobian no covariance.
    good = (
        F.col("_lo").isNotNull()
        & F.col("_hi").isNotNull()
        & (F.col("n") > 3)
        & _finite(reduce(Column.__add__, covariance.values()))
    )
    r2 = F.try_divide(F.col("total") - F.col("ss"), F.col("total"))
    shown = {**{p: F.col(p) for p in AT}, **covariance, "r_squared": r2}
    return fits.select(
        *by,
        *[F.when(good, value).alias(name) for name, value in shown.items()],
        "n",
        F.coalesce(good, F.lit(False)).alias("converged"),
    )


def fitted_curve(df: DataFrame, fits: DataFrame, x: str = "Nof_Mths", by: Sequence[str] = ()) -> DataFrame:
    """Rows with `fitted`, from the table of fits (one row per group)."""
    fitted = exponential_decay(F.col(x), F.col("_f.a"), F.col("_f.b"), F.col("_f.c"))
    params = F.struct("a", "b", "c").alias("_f")
    if by:
        joined = null_safe_join(df, fits.select(*by, params), list(by))
    else:
        joined = df.withColumn("_f", fits.select(params).scalar())
    return joined.withColumn("fitted", fitted).drop("_f")
