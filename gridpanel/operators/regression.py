"""Panel regressions from cross-product matrices.

With A the cross products of the rows and, over customers with T rows and mean m,
B1 = sum T m m', B2 = sum m m', S2 = sum T^2 m m':

    pooling   A
    within    A - B1
    between   B2
    random    A - sum (2 h - h^2) T m m',  h = 1 - sqrt(s_e / (s_e + T s_u))

The variance components s_e (rows) and s_u (customers) are Swamy-Arora's or
Wallace-Hussain's for unbalanced panels; a negative s_u counts as 0.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridpanel import constants as C
from gridpanel.functions import tails
from gridpanel.operators.moments import (
    PanelProducts,
    cross_products,
    least_squares,
    trace_product,
)
from gridpanel.operators.panel import demean_within
from gridpanel.operators.segments import resolve_dummy

CONSTANT = "(Intercept)"
MODELS = ("pooling", "within", "between", "random")
COEFFICIENTS = T.StructType(
    [
        T.StructField("model", T.StringType()),
        T.StructField("term", T.StringType()),
        T.StructField("coef", T.DoubleType()),
        T.StructField("se", T.DoubleType()),
        T.StructField("stat", T.DoubleType()),
        T.StructField("p", T.DoubleType()),
        T.StructField("r2", T.DoubleType()),
        T.StructField("n", T.LongType()),
    ]
)


@dataclass
class Fit:
    """One fitted model; coefficients of dropped terms are None."""

    model: str
    terms: list[str]
    coefficients: np.ndarray
    covariance: np.ndarray
    r2: float
    n: int
    df: float
    group: tuple = ()
    s_e: float | None = None
    s_u: float | None = None
    extra: dict = field(default_factory=dict)

    def coefficient(self, term: str) -> float:
        return float(self.coefficients[self.terms.index(term)])

    def used(self) -> dict[str, float]:
        """Terms that were not dropped, with their coefficients."""
        return {
            t: float(b) for t, b in zip(self.terms, self.coefficients) if not math.isnan(b)
        }

    def rows(self, name: str | None = None) -> list[tuple]:
        out, r2 = [], None if math.isnan(self.r2) else float(self.r2)
        for i, term in enumerate(self.terms):
            b, variance = float(self.coefficients[i]), float(self.covariance[i, i])
            if math.isnan(b):
                out.append((name or self.model, term, None, None, None, None, r2, self.n))
                continue
            se = math.sqrt(variance) if variance > 0 else None
            stat = b / se if se else None
            if stat is None or (self.model != "random" and self.df <= 0):
                p = None
            elif self.model == "random":
                p = tails.normal_p(stat)
            else:
                p = tails.student_p(stat, float(self.df))
            out.append((name or self.model, term, b, se, stat, p, r2, self.n))
        return out


def coefficient_table(spark: SparkSession, fits: Mapping[str, Fit]) -> DataFrame:
    """Long table of all models' coefficients."""
    rows = [row for name, fit in fits.items() for row in fit.rows(name)]
    return spark.createDataFrame(rows, COEFFICIENTS)


def compare(table: DataFrame) -> DataFrame:
    """Coefficients side by side: one row per term, one column per model."""
    return table.groupBy("term").pivot("model").agg(F.first("coef"))


def _model_rows(
    df: DataFrame, y: str, xs: Sequence[str], keep: Sequence[str]
) -> DataFrame:
    """Rows complete in all variables, numbers as doubles."""
    numbers = [F.col(c).cast("double").alias(c) for c in dict.fromkeys([*xs, y])]
    keys = [c for c in dict.fromkeys(keep) if c not in (*xs, y)]
    return df.select(*keys, *numbers).dropna(subset=[*xs, y])


def panel_moments(
    df: DataFrame,
    y: str = C.OUTCOME,
    xs: Sequence[str] = C.CONTINUOUS_VARS,
    id_col: str = "nis_rad",
    by: Sequence[str] = (),
) -> DataFrame:
    """Per customer: number of complete rows `T` and the mean of every variable."""
    rows = _model_rows(df, y, xs, [*by, id_col])
    return rows.groupBy(*by, id_col).agg(
        F.count(F.lit(1)).alias("T"), *[F.avg(c).alias(c) for c in [*xs, y]]
    )


def _embed(inverse: np.ndarray, kept: Sequence[int], size: int) -> np.ndarray:
    out = np.full((size, size), np.nan)
    out[np.ix_(kept, kept)] = inverse
    return out


def _uncentre(coefficients, covariance, means):
    """Coefficients on the original scale; only the constant changes."""
    k = len(coefficients)
    shift = np.eye(k)
    shift[0, 1:] = -np.asarray(means[:-1])
    known = ~np.isnan(coefficients)
    b = np.where(known, coefficients, 0.0)
    v = np.where(np.isnan(covariance), 0.0, covariance)
    out, spread = shift @ b, shift @ v @ shift.T
    out[0] += means[-1]
    out[~known] = np.nan
    spread[~known, :] = np.nan
    spread[:, ~known] = np.nan
    return out, spread


def _solve(model, terms, gram, n, df_base, tss, means, group) -> Fit:
    """Least squares from the cross products of [1, x, y] (or [x, y] without constant)."""
    b, ssr, inverse, kept = least_squares(gram[:-1, :-1], gram[:-1, -1], gram[-1, -1])
    df = df_base - len(kept)
    covariance = _embed(inverse, kept, len(terms)) * (ssr / df if df > 0 else np.nan)
    if means is not None:
        b, covariance = _uncentre(b, covariance, means)
    r2 = 1 - ssr / tss if tss > 0 else float("nan")
    return Fit(model, list(terms), b, covariance, r2, int(n), df, group, extra={"ssr": ssr, "kept": kept})


def _flattened(a: np.ndarray, b1: np.ndarray) -> np.ndarray:
    """A - B1, with nothing left of variables that do not vary within customers."""
    w = a - b1
    flat = np.diag(w) <= 1e-10 * np.maximum(np.diag(a), 1e-300)
    flat[-1] = False
    w[flat, :] = 0.0
    w[:, flat] = 0.0
    return w


def _swamy_arora(a, b1, s2, n_rows, n_ids) -> tuple[float, float]:
    w = _flattened(a, b1)
    _, ssr, _, kept = least_squares(w[1:-1, 1:-1], w[1:-1, -1], w[-1, -1])
    s_e = ssr / max(n_rows - n_ids - len(kept), 1)
    _, q_b, _, used = least_squares(b1[:-1, :-1], b1[:-1, -1], b1[-1, -1])
    trace = trace_product(b1[:-1, :-1], s2[:-1, :-1], used)
    s_u = (q_b - (n_ids - len(used)) * s_e) / max(n_rows - trace, 1e-12)
    return s_e, max(0.0, s_u)


def _wallace_hussain(a, b1, s2, n_rows, n_ids) -> tuple[float, float]:
    b, _, inverse, kept = least_squares(a[:-1, :-1], a[:-1, -1], a[-1, -1])
    at = np.ix_(kept, kept)
    c = np.append(-b[kept], 1.0)  # residual = c' [x, y]
    full = np.ix_([*kept, len(a) - 1], [*kept, len(a) - 1])
    q2 = float(c @ b1[full] @ c)
    q1 = float(c @ a[full] @ c) - q2
    xzx, xpx, k = s2[at], b1[at], len(kept)
    t_z, t_p = np.trace(inverse @ xzx), np.trace(inverse @ xpx)
    t_pz = np.trace(inverse @ xpx @ inverse @ xzx)
    system = np.array(
        [[t_z - t_pz, n_rows - n_ids - k + t_p], [n_rows - 2 * t_z + t_pz, n_ids - t_p]]
    )
    s_u, s_e = np.linalg.solve(system, [q1, q2])
    return max(float(s_e), 1e-300), max(0.0, float(s_u))


COMPONENTS = {"swar": _swamy_arora, "walhus": _wallace_hussain}


def _pull(t, s_e: float, s_u: float):
    """h for a customer with `t` rows, a number or a Column."""
    return 1 - (s_e / (s_e + t * s_u)) ** 0.5


@dataclass(frozen=True)
class Spec:
    """Variables of a model and the estimators to apply."""

    xs: tuple[str, ...]
    models: tuple[str, ...] = ("random",)
    method: str = "swar"


def fit_family(
    df: DataFrame,
    y: str,
    specs: Mapping[str, Spec],
    id_col: str = "nis_rad",
    by: Sequence[str] = (),
    own: str | None = None,
) -> dict[tuple, Fit]:
    """All models of a family, for every group of `by`; keys are (group..., spec, model).

    Four jobs, however many groups and models there are: means, one table of products, its totals, and
    the matrices of all random-effects models together. Where values are missing, each model has its own rows,
    those complete in its variables. With `own`, a column of names of models, a row serves only that model.
    """
    for spec in specs.values():
        if set(spec.models) - set(MODELS) or spec.method not in COMPONENTS:
            raise ValueError(f"unknown model or method: {spec}")
    variables = list(dict.fromkeys(x for spec in specs.values() for x in spec.xs))
    numbers = [F.col(f"`{c}`").cast("double").alias(c) for c in [*variables, y]]
    keys = [c for c in dict.fromkeys([*by, id_col, *([own] if own else [])]) if c not in (*variables, y)]
    rows = df.select(*keys, *numbers).dropna(subset=[y]).persist()
    try:
        found = rows.agg(
            F.count(F.lit(1)).alias("_n"),
            *[F.avg(c).alias(f"m_{c}") for c in [*variables, y]],
            *[F.count(c).alias(f"n_{c}") for c in variables],
        ).first()
        # Any constant would do for centring; it keeps the sums small.
        means = {c: found[f"m_{c}"] or 0.0 for c in [*variables, y]}
        whole = {name: reduce(Column.__and__, [F.col(x).isNotNull() for x in spec.xs], F.lit(True)) for name, spec in specs.items()}
        if own:
            fitting = [(F.col(own) == name) & complete for name, complete in whole.items()]
            sets = rows.filter(reduce(Column.__or__, fitting)).withColumn("_set", F.col(own))
        elif all(found[f"n_{c}"] == found["_n"] for c in variables):
            sets = rows.withColumn("_set", F.lit(""))
        else:
            names = F.array(*[F.when(complete, F.lit(name)) for name, complete in whole.items()])
            sets = rows.withColumn("_set", F.explode(F.array_compact(names)))
        return _fit_sets(sets, y, variables, specs, means, id_col, by)
    finally:
        rows.unpersist()


def _fit_sets(
    rows: DataFrame,
    y: str,
    variables: Sequence[str],
    specs: Mapping[str, Spec],
    means: Mapping[str, float],
    id_col: str,
    by: Sequence[str],
) -> dict[tuple, Fit]:
    """Fits from rows whose `_set` names the model they serve, or is empty for all of them."""
    # A variable that a model does not have may be missing in its rows; its products are not looked at.
    columns = [F.lit(1.0), *[F.coalesce(F.col(c) - F.lit(means[c]), F.lit(0.0)) for c in [*variables, y]]]
    products = PanelProducts(rows, columns, id_col, [*by, "_set"])
    todo = {}
    for (*group, served), parts in products.totals().items():
        for name in [served] if served else specs:
            at = [0, *[variables.index(x) + 1 for x in specs[name].xs], len(variables) + 1]
            pick = np.ix_(at, at)
            todo[(*group, served, name)] = (pick, {k: m[pick] for k, m in parts.items()})
    components = {}
    for key, (_, parts) in todo.items():
        spec = specs[key[-1]]
        if "random" in spec.models:
            a, b1, b2, s2 = (parts[k] for k in ("a", "b1", "b2", "s2"))
            components[key] = COMPONENTS[spec.method](a, b1, s2, a[0, 0], b2[0, 0])
    pulled = {}
    if components:
        numbers = [(*key, float(s_e), float(s_u)) for key, (s_e, s_u) in components.items()]
        pulled = products.weighted(numbers, ["_se", "_su"], _pulled_weights)
    fits = {}
    for key, (pick, parts) in todo.items():
        name, group = key[-1], key[:-2]
        centre = [*[means[x] for x in specs[name].xs], means[y]]
        own = {k: m[pick] for k, m in pulled.get(key, {}).items()}
        for model in specs[name].models:
            fits[(*group, name, model)] = _fit_one(
                model, specs[name], parts, centre, group, components.get(key), own
            )
    return fits


def _pulled_weights(t: Column, s_e: Column, s_u: Column) -> dict[str, Column]:
    """Weights of the products that random effects take off, and of what is left of the means."""
    h = _pull(t, s_e, s_u)
    return {"off": (2 * h - h * h) * t, "left": (1 - h) * t}


def _fit_one(model, spec, parts, means, group, components, pulled) -> Fit:
    a, b1, b2 = parts["a"], parts["b1"], parts["b2"]
    n_rows, n_ids = a[0, 0], b2[0, 0]
    terms = [CONSTANT, *spec.xs]
    if model == "pooling":
        tss = a[-1, -1] - a[0, -1] ** 2 / n_rows
        return _solve(model, terms, a, n_rows, n_rows, tss, means, group)
    if model == "within":
        w = _flattened(a, b1)[1:, 1:]
        return _solve(model, spec.xs, w, n_rows, n_rows - n_ids, w[-1, -1], None, group)
    if model == "between":
        tss = b2[-1, -1] - b2[0, -1] ** 2 / n_ids
        return _solve(model, terms, b2, n_ids, n_ids, tss, means, group)
    gram, left = a - pulled["off"], pulled["left"]
    # Squares of the transformed outcome around its mean, before centring by m.
    m = means[-1]
    squares = gram[-1, -1] + 2 * m * gram[0, -1] + m * m * gram[0, 0]
    tss = squares - (left[0, -1] + m * left[0, 0]) ** 2 / n_rows
    fit = _solve(model, terms, gram, n_rows, n_rows, tss, means, group)
    fit.s_e, fit.s_u = components
    return fit


def panel_fits(
    df: DataFrame,
    y: str = C.OUTCOME,
    xs: Sequence[str] = C.CONTINUOUS_VARS,
    models: Sequence[str] = ("pooling", "random", "within"),
    method: str = "swar",
    id_col: str = "nis_rad",
    by: Sequence[str] = (),
) -> dict[tuple, Fit]:
    """Several estimators of one model, for every group of `by`: (group..., estimator)."""
    found = fit_family(df, y, {"": Spec(tuple(xs), tuple(models), method)}, id_col, by)
    return {(*key[:-2], key[-1]): fit for key, fit in found.items()}


def panel_fit(
    df: DataFrame,
    y: str = C.OUTCOME,
    xs: Sequence[str] = C.CONTINUOUS_VARS,
    model: str = "random",
    method: str = "swar",
    id_col: str = "nis_rad",
) -> Fit:
    return panel_fits(df, y, xs, [model], method, id_col)[(model,)]


def ols(df: DataFrame, y: str, xs: Sequence[str]) -> Fit:
    """Least squares with a constant over rows complete in all variables."""
    xs = list(xs)
    rows = _model_rows(df, y, xs, [])
    variables = [*xs, y]
    centre = rows.agg(*[F.avg(c).alias(c) for c in variables]).first()
    means = [centre[c] or 0.0 for c in variables]
    columns = [F.lit(1.0), *[F.col(c) - m for c, m in zip(variables, means)]]
    a = cross_products(rows, columns)[()]
    tss = a[-1, -1] - a[0, -1] ** 2 / a[0, 0]
    return _solve("ols", ["const", *xs], a, a[0, 0], a[0, 0], tss, means, ())


def panel_regression(
    df: DataFrame,
    y: str = C.OUTCOME,
    xs: Sequence[str] = C.CONTINUOUS_VARS,
    by: str = "rural_urban",
) -> dict[str, Fit]:
    """Pooling, random and within models for urban and rural customers, in one go."""
    rows = df.filter(F.col(by).isin("Urban", "Rural"))
    fits = panel_fits(rows, y, xs, ("pooling", "random", "within"), by=[by])
    short = {"pooling": "pool", "random": "re", "within": "fe"}
    return {
        f"{short[model]}_{location[0].lower()}": fit for (location, model), fit in fits.items()
    }


def one_hot(df: DataFrame, column: str) -> tuple[DataFrame, list[str]]:
    """0/1 columns for all levels but the first, of a column with few levels (years)."""
    levels = [r[0] for r in df.select(column).distinct().orderBy(column).collect()]
    levels = [v for v in levels if v is not None][1:]
    names = {f"{column}{v}": (F.col(column) == v).cast("double") for v in levels}
    return (df.withColumns(names) if names else df), list(names)


def mundlak(
    df: DataFrame,
    y: str = C.OUTCOME,
    time_varying: Sequence[str] = C.TIME_VARYING_VARS,
    time_invariant: Sequence[str] = C.TIME_INVARIANT_VARS,
    id_col: str = "nis_rad",
) -> Fit:
    """Correlated random effects: demeaned variables with their means, Wallace-Hussain."""
    rows = demean_within(df, time_varying, id_col)
    xs = [*time_varying, *time_invariant, *[f"{c}_mean" for c in time_varying]]
    if "Year_of_connection" in df.columns:
        rows, years = one_hot(rows, "Year_of_connection")
        xs += years
    return panel_fit(rows, y, xs, "random", "walhus", id_col)


def between(
    df: DataFrame,
    y: str = C.OUTCOME,
    xs: Sequence[str] = (
        "fsp",
        "population",
        "Night_Lights",
        "Electrification",
        "total_structs",
        "min_dist2_road",
    ),
) -> Fit:
    return panel_fit(df, y, xs, "between")


def _base_variable(df: DataFrame, dummy: str) -> str:
    return resolve_dummy(df, dummy).replace("_dummy", "")


def _controls(df: DataFrame, dummies: Sequence[str], controls: Sequence[str]) -> list[str]:
    """Controls without the variables the dummies were made from."""
    bases = {_base_variable(df, d) for d in dummies}
    return [c for c in controls if c not in bases]


def _high(df: DataFrame, dummies: Sequence[str]) -> tuple[DataFrame, dict[str, str]]:
    """0/1 column `<dummy>High` for each dummy."""
    names = {d: f"{resolve_dummy(df, d)}High" for d in dummies}
    high = {n: (F.col(resolve_dummy(df, d)) == "High").cast("double") for d, n in names.items()}
    return df.withColumns(high), names


def dummy_effects(
    df: DataFrame,
    dummies: Sequence[str] = C.DUMMY_VARS,
    controls: Sequence[str] = C.DUMMY_CONTROLS,
    y: str = C.OUTCOME,
) -> dict[str, Fit]:
    """One random-effects model per dummy."""
    rows, names = _high(df, dummies)
    specs = {
        d.replace("_dummy", ""): Spec(
            (*_controls(df, [d], controls), names[d]), method="walhus"
        )
        for d in dummies
    }
    return {name: fit for (name, _), fit in fit_family(rows, y, specs).items()}


def subsamples(
    df: DataFrame,
    dummies: Sequence[str] = C.DUMMY_VARS,
    controls: Sequence[str] = C.DUMMY_CONTROLS,
    y: str = C.OUTCOME,
) -> dict[str, Fit]:
    """Random-effects models of the Low and the High rows of every dummy."""
    levels = F.array(
        *[
            F.struct(
                F.lit(d.replace("_dummy", "")).alias("_dummy"),
                F.col(resolve_dummy(df, d)).alias("_level"),
            )
            for d in dummies
        ]
    )
    rows = df.select("nis_rad", y, *controls, F.inline(levels))
    rows = rows.filter(F.col("_level").isin("Low", "High"))
    specs = {
        d.replace("_dummy", ""): Spec(tuple(_controls(df, [d], controls)), method="walhus")
        for d in dummies
    }
    fits = fit_family(rows, y, specs, by=["_level"], own="_dummy")
    return {
        f"{name}.{level.lower()}": fits[(level, name, "random")]
        for name in specs
        for level in ("Low", "High")
        if (level, name, "random") in fits
    }


def interactions(
    df: DataFrame,
    pairs: Sequence[tuple[str, str]] = C.DUMMY_INTERACTIONS,
    controls: Sequence[str] = C.DUMMY_CONTROLS,
    y: str = C.OUTCOME,
) -> dict[str, Fit]:
    """Random-effects models with two dummies and their product, on demeaned data."""
    rows, names = _high(demean_within(df), list(dict.fromkeys(d for p in pairs for d in p)))
    specs = {}
    for d1, d2 in pairs:
        product = f"{names[d1]}:{names[d2]}"
        rows = rows.withColumn(product, F.col(names[d1]) * F.col(names[d2]))
        label = f"{d1.replace('_dummy', '')}_x_{d2.replace('_dummy', '')}"
        xs = (*_controls(df, [d1, d2], controls), names[d1], names[d2], product)
        specs[label] = Spec(xs, method="walhus")
    return {name: fit for (name, _), fit in fit_family(rows, y, specs).items()}


def quasi_demeaned(
    df: DataFrame, fit: Fit, y: str, xs: Sequence[str], id_col: str, keep: Sequence[str] = ()
) -> DataFrame:
    """Rows as the random-effects model sees them: constant `_one`, variables, `_resid`."""
    rows = _model_rows(df, y, xs, [id_col, *keep])
    means = panel_moments(df, y, xs, id_col).select(
        id_col, "T", *[F.col(c).alias(f"_m_{c}") for c in [*xs, y]]
    )
    h = _pull(F.col("T"), fit.s_e, fit.s_u)
    joined = rows.join(means, id_col).withColumn("_h", h)
    pulled = joined.withColumns(
        {c: F.col(c) - F.col("_h") * F.col(f"_m_{c}") for c in [*xs, y]}
    ).withColumn("_one", 1 - F.col("_h"))
    used = fit.used()
    fitted = reduce(
        Column.__add__,
        [F.lit(b) * F.col("_one" if t == CONSTANT else t) for t, b in used.items()],
    )
    kept = [c for c in keep if c not in (*xs, y, id_col)]
    return pulled.select(
        id_col, *kept, "_one", *xs, y, (F.col(y) - fitted).alias("_resid")
    )


def require_unique_periods(df: DataFrame, id_col: str, time_col: str) -> None:
    """Panel models with lags need one row per customer and period.

    It also bounds the rows of a customer by the number of periods, so a window over
    one customer stays small.
    """
    twice = df.groupBy(id_col, time_col).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if not twice.isEmpty():
        raise ValueError(f"({id_col}, {time_col}) does not identify a row")


def lag_within(
    df: DataFrame,
    columns: Sequence[str],
    lags: int = 1,
    id_col: str = "nis_rad",
    time_col: str = "Nof_Mths",
    suffix: str = "_lag",
) -> DataFrame:
    """Previous rows' values of the same customer, never of another."""
    order = Window.partitionBy(id_col).orderBy(time_col)
    if lags == 1:
        return df.withColumns({f"{c}{suffix}": F.lag(c).over(order) for c in columns})
    return df.withColumns(
        {f"{c}{suffix}{n}": F.lag(c, n).over(order) for c in columns for n in range(1, lags + 1)}
    )


def newey_west(
    df: DataFrame,
    y: str = C.OUTCOME,
    xs: Sequence[str] = (
        "Night_Lights",
        "Electrification",
        "fsp",
        "min_dist2_road",
        "population",
        "total_structs",
        "GDP",
    ),
    interaction: tuple[str, str] | None = ("population", "total_structs"),
    id_col: str = "nis_rad",
    time_col: str = "Nof_Mths",
) -> Fit:
    """Random effects with standard errors robust to serial correlation within customers.

    Scores u_t = x_t e_t; the middle matrix is sum u_t u_t' plus, for lags l up to
    L = floor(T ** 0.25), (1 - l / (L + 1)) (u_t u_{t-l}' + its transpose).
    """
    xs = list(xs)
    if interaction:
        product = ":".join(interaction)
        df = df.withColumn(product, F.col(interaction[0]) * F.col(interaction[1]))
        xs.append(product)
    fit = panel_fit(df, y, xs, "random", "swar", id_col)
    require_unique_periods(_model_rows(df, y, xs, [id_col, time_col]), id_col, time_col)
    used = [t for t in fit.used()]
    rows = quasi_demeaned(df, fit, y, xs, id_col, [time_col])
    columns = ["_one" if t == CONSTANT else t for t in used]
    scores = rows.select(
        id_col,
        time_col,
        *[(F.col(c) * F.col("_resid")).alias(f"_u{i}") for i, c in enumerate(columns)],
    )
    longest = rows.groupBy(id_col).agg(F.count(F.lit(1)).alias("t")).agg(F.max("t")).first()[0]
    lags = int(math.floor(longest**0.25 + 1e-9))
    k = len(columns)
    order = Window.partitionBy(id_col).orderBy(time_col)
    # v_t = u_t / 2 + sum of weighted lags, so that sum u v' + v u' is the middle matrix.
    halves = {}
    for i in range(k):
        value = F.col(f"_u{i}") / 2
        for n in range(1, lags + 1):
            earlier = F.coalesce(F.lag(f"_u{i}", n).over(order), F.lit(0.0))
            value = value + (1 - n / (lags + 1)) * earlier
        halves[f"_v{i}"] = value
    both = scores.withColumns(halves)
    sums = [
        F.sum(F.col(f"_u{i}") * F.col(f"_v{j}")).alias(f"m{i}_{j}")
        for i in range(k)
        for j in range(k)
    ]
    found = both.agg(*sums).first()
    cross = np.array([[found[f"m{i}_{j}"] for j in range(k)] for i in range(k)])
    at = [fit.terms.index(t) for t in used]
    bread = fit.covariance[np.ix_(at, at)] / (fit.extra["ssr"] / fit.df)
    robust = bread @ (cross + cross.T) @ bread
    fit.covariance = _embed(robust, at, len(fit.terms))
    fit.extra["lags"] = lags
    return fit


def cochrane_orcutt(
    df: DataFrame,
    y: str = C.OUTCOME,
    xs: Sequence[str] = (
        "total_structs",
        "min_dist2_road",
        "fsp",
        "population",
        "Electrification",
        "Night_Lights",
        "GDP",
    ),
    id_col: str = "nis_rad",
    time_col: str = "Nof_Mths",
) -> dict:
    """Random effects before and after quasi-differencing with the residuals' AR(1).

    Returns the two fits and `rho`, the coefficient of the lagged residual.
    """
    xs = list(xs)
    rows = _model_rows(df, y, xs, [id_col, time_col])
    require_unique_periods(rows, id_col, time_col)
    original = panel_fit(rows, y, xs, "random", "swar", id_col)
    residuals = quasi_demeaned(rows, original, y, xs, id_col, [time_col]).select(
        id_col, time_col, F.col("_resid").alias("residuals")
    )
    joined = rows.join(residuals, [id_col, time_col])
    lagged = lag_within(joined, ["residuals"], 1, id_col, time_col)
    aux = panel_fit(lagged, "residuals", ["residuals_lag", *xs], "random", "swar", id_col)
    rho = aux.coefficient("residuals_lag")
    steps = lag_within(rows, [y, *xs], 1, id_col, time_col)
    differenced = steps.withColumns(
        {c: F.col(c) - rho * F.col(f"{c}_lag") for c in [y, *xs]}
    ).select(id_col, time_col, y, *xs)
    transformed = panel_fit(differenced, y, xs, "random", "swar", id_col)
    return {"original": original, "transformed": transformed, "rho": rho, "aux": aux}


def fixed_effects(
    df: DataFrame, fit: Fit, y: str, xs: Sequence[str], id_col: str = "nis_rad"
) -> DataFrame:
    """(id, FE): mean outcome less the fitted part of the mean variables."""
    means = panel_moments(df, y, xs, id_col)
    part = reduce(
        Column.__add__, [F.lit(b) * F.col(t) for t, b in fit.used().items()], F.lit(0.0)
    )
    return means.select(id_col, (F.col(y) - part).alias("FE"))


def two_stage(
    df: DataFrame,
    y: str = C.OUTCOME,
    xs: Sequence[str] = (
        "fsp",
        "population",
        "Night_Lights",
        "GDP",
        "Electrification",
        "total_structs",
        "min_dist2_road",
    ),
    second: Sequence[str] = C.TIME_INVARIANT_VARS,
    id_col: str = "nis_rad",
) -> dict[str, Fit]:
    """Fixed effects, the between regression of those effects, and Mundlak beside them."""
    within = panel_fit(df, y, xs, "within", id_col=id_col)
    effects = fixed_effects(df, within, y, xs, id_col)
    rows = df.select(id_col, *second).join(effects, id_col, "left")
    return {
        "fe": within,
        "between": panel_fit(rows, "FE", second, "between", id_col=id_col),
        "mundlak": mundlak(df, y, id_col=id_col),
    }


def regression_suite(df: DataFrame) -> dict[str, dict[str, Fit]]:
    """Basic panel models, Mundlak, dummy effects and interactions by location."""
    parts = {
        "urban": df.filter(F.col("rural_urban") == "Urban"),
        "rural": df.filter(F.col("rural_urban") == "Rural"),
    }
    return {
        "basic": panel_regression(df),
        "mundlak": {name: mundlak(part) for name, part in parts.items()},
        **{f"dummy_{name}": dummy_effects(part) for name, part in parts.items()},
        **{f"interactions_{name}": interactions(part) for name, part in parts.items()},
    }
