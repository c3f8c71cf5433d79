import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridpanel.functions import tails
from gridpanel.operators import moments, panel, regression
from gridpanel.plans import analysis
from registry import model_queries

XS = ["x1", "x2", "z"]


@pytest.fixture(scope="module")
def toy():
    """Unbalanced panel; z does not vary within customers."""
    rng = np.random.default_rng(11)
    rows = []
    for i in range(25):
        u, z = rng.normal() * 2, rng.normal()
        for t in sorted(rng.choice(12, rng.integers(2, 12), replace=False)):
            x1, x2 = rng.normal() + u / 3, rng.normal()
            rows.append((i, int(t), x1, x2, z, 5 + 2 * x1 - x2 + 0.5 * z + u + rng.normal()))
    return pd.DataFrame(rows, columns=["nis_rad", "Nof_Mths", "x1", "x2", "z", "y"])


@pytest.fixture(scope="module")
def rows(spark, toy):
    return spark.createDataFrame(toy).persist()


def dense(toy, xs, method):
    """Random effects by explicit matrices: variance components, then weighted data."""
    ids = toy.nis_rad.values
    z = (ids[:, None] == np.unique(ids)[None]).astype(float)
    p = z @ np.linalg.inv(z.T @ z) @ z.T
    q = np.eye(len(toy)) - p
    x = np.column_stack([np.ones(len(toy)), toy[xs]])
    y = toy.y.values
    n_rows, n_ids, k = len(toy), z.shape[1], x.shape[1]
    varying = [i for i in range(1, k) if not np.allclose(q @ x[:, i], 0)]
    if method == "swar":
        w = q @ x[:, varying]
        e = q @ y - w @ np.linalg.lstsq(w, q @ y, rcond=None)[0]
        s_e = e @ e / (n_rows - n_ids - len(varying))
        b = np.linalg.lstsq(p @ x, p @ y, rcond=None)[0]
        q_b = ((p @ y - p @ x @ b) ** 2).sum()
        trace = np.trace(np.linalg.inv(x.T @ p @ x) @ x.T @ z @ z.T @ x)
        s_u = (q_b - (n_ids - k) * s_e) / (n_rows - trace)
    else:
        a = np.linalg.inv(x.T @ x)
        m = np.eye(n_rows) - x @ a @ x.T
        e = m @ y
        # Expected quadratic forms of the pooled residuals, from the covariance s_u ZZ' + s_e I.
        forms = [[np.trace(m @ f @ m @ z @ z.T), np.trace(m @ f @ m)] for f in (q, p)]
        s_u, s_e = np.linalg.solve(forms, [e @ q @ e, e @ p @ e])
    t = z.sum(axis=0)
    h = (1 - np.sqrt(s_e / (s_e + t * max(s_u, 0))))[np.searchsorted(np.unique(ids), ids)]
    xs_, ys_ = x - h[:, None] * (p @ x), y - h * (p @ y)
    b = np.linalg.lstsq(xs_, ys_, rcond=None)[0]
    e = ys_ - xs_ @ b
    v = np.linalg.inv(xs_.T @ xs_)
    sigma = e @ e / (n_rows - k)
    r2 = 1 - e @ e / ((ys_ - ys_.mean()) ** 2).sum()
    return {"b": b, "se": np.sqrt(np.diag(v) * sigma), "s_e": s_e, "s_u": max(s_u, 0), "r2": r2,
            "x": xs_, "e": e, "v": v}


@pytest.mark.parametrize("method", ["swar", "walhus"])
def test_random_effects_equal_dense_matrices(rows, toy, method):
    fit = regression.panel_fit(rows, "y", XS, "random", method)
    expected = dense(toy, XS, method)
    assert np.allclose(fit.coefficients, expected["b"])
    assert np.allclose(np.sqrt(np.diag(fit.covariance)), expected["se"])
    assert np.isclose(fit.s_e, expected["s_e"]) and np.isclose(fit.s_u, expected["s_u"])
    assert np.isclose(fit.r2, expected["r2"]) and fit.n == len(toy)


def test_pooling_between_and_ols(rows, toy):
    x = np.column_stack([np.ones(len(toy)), toy[XS]])
    b = np.linalg.lstsq(x, toy.y, rcond=None)[0]
    for fit in (regression.panel_fit(rows, "y", XS, "pooling"), regression.ols(rows, "y", XS)):
        assert np.allclose(fit.coefficients, b)
        e = toy.y - x @ b
        se = np.sqrt(np.diag(np.linalg.inv(x.T @ x)) * (e @ e) / (len(toy) - 4))
        assert np.allclose(np.sqrt(np.diag(fit.covariance)), se)
    means = toy.groupby("nis_rad").mean()
    xm = np.column_stack([np.ones(len(means)), means[XS]])
    between = regression.panel_fit(rows, "y", XS, "between")
    assert np.allclose(between.coefficients, np.linalg.lstsq(xm, means.y, rcond=None)[0])
    assert between.n == len(means)


def test_within_drops_what_does_not_vary(rows, toy):
    fit = regression.panel_fit(rows, "y", XS, "within")
    d = toy - toy.groupby("nis_rad").transform("mean").assign(nis_rad=0, Nof_Mths=0)
    b = np.linalg.lstsq(d[["x1", "x2"]], d.y, rcond=None)[0]
    assert np.allclose(fit.coefficients[:2], b) and math.isnan(fit.coefficients[2])
    table = fit.rows("fe")
    assert table[2][2] is None and table[0][0] == "fe"
    e = d.y - d[["x1", "x2"]].values @ b
    se = np.sqrt(np.diag(np.linalg.inv(d[["x1", "x2"]].T @ d[["x1", "x2"]])) * (e @ e) / (len(toy) - 25 - 2))
    assert np.allclose(np.sqrt(np.diag(fit.covariance))[:2], se)


def test_groups_and_families_equal_single_fits(spark, rows):
    grouped = rows.withColumn("g", F.when(F.col("nis_rad") < 12, "p").otherwise("q"))
    fits = regression.panel_fits(grouped, "y", XS, ("pooling", "random", "within"), by=["g"])
    for g in "pq":
        part = grouped.filter(F.col("g") == g)
        for model in ("pooling", "random", "within"):
            one = regression.panel_fit(part, "y", XS, model)
            assert np.allclose(fits[(g, model)].coefficients, one.coefficients, equal_nan=True)
    specs = {"a": regression.Spec(("x1",)), "b": regression.Spec(("x2", "z"), method="walhus")}
    family = regression.fit_family(rows, "y", specs)
    assert np.allclose(family[("b", "random")].coefficients,
                       regression.panel_fit(rows, "y", ["x2", "z"], "random", "walhus").coefficients)


def test_gaps_leave_each_model_its_own_rows(rows, toy):
    gappy = rows.withColumn("x2", F.when(F.col("Nof_Mths") != 3, F.col("x2")))
    specs = {"a": regression.Spec(("x1",), ("pooling",)), "b": regression.Spec(("x2",), ("pooling",))}
    family = regression.fit_family(gappy, "y", specs)
    assert family[("a", "pooling")].n == len(toy)
    assert family[("b", "pooling")].n == (toy.Nof_Mths != 3).sum()


def test_products_of_all_groups_take_any_weight(rows):
    grouped = rows.withColumn("g", F.when(F.col("nis_rad") < 12, "p"))  # the other group has no name
    made = moments.PanelProducts(grouped, [F.lit(1.0), F.col("x1")], "nis_rad", ["g"])
    known = grouped.groupBy("g", "nis_rad").agg(F.count(F.lit(1)).alias("t"), F.avg("x1").alias("x1")).toPandas()
    totals = made.totals()
    asked = [("p", "one", 2.0), (None, "one", 2.0), (None, "two", 5.0)]
    found = made.weighted(asked, ["_k"], lambda t, k: {"w": 1 / (k + t)})
    assert set(found) == {key[:2] for key in asked}
    for (g, label, k) in asked:
        part = known[known.g.isna()] if g is None else known[known.g == g]
        means = np.column_stack([np.ones(len(part)), part.x1])
        for name, w in (("b1", part.t), ("b2", part.t**0), ("s2", part.t**2)):
            assert np.allclose(totals[(g,)][name], (means * w.values[:, None]).T @ means)
        assert np.allclose(found[(g, label)]["w"], (means / (k + part.t.values[:, None])).T @ means)


def test_a_row_may_serve_one_model_only(rows):
    copies = rows.withColumn("own", F.explode(F.array(F.lit("a"), F.lit("b")))).filter("own = 'a' or Nof_Mths < 5")
    copies = copies.withColumn("x1", F.when(F.col("own") == "a", F.col("x1")))
    specs = {"a": regression.Spec(("x1",), ("pooling", "random")), "b": regression.Spec(("x2",), ("pooling", "random"))}
    family = regression.fit_family(copies, "y", specs, own="own")
    early = rows.filter("Nof_Mths < 5")
    for model in ("pooling", "random"):
        assert np.allclose(family[("a", model)].coefficients, regression.panel_fit(rows, "y", ["x1"], model).coefficients)
        assert np.allclose(family[("b", model)].coefficients, regression.panel_fit(early, "y", ["x2"], model).coefficients)


def test_a_family_takes_four_jobs(spark, rows):
    grouped = rows.withColumn("g", F.col("nis_rad") % 6)
    specs = {name: regression.Spec(("x1", "x2"), ("pooling", "within", "random")) for name in "abc"}
    regression.panel_fit(rows, "y", ["x1"], "pooling")  # starts whatever has to be started
    tracker, group = spark.sparkContext.statusTracker(), "family"
    spark.sparkContext.setJobGroup(group, "jobs of a family")
    regression.fit_family(grouped, "y", specs, by=["g"])
    many = len(tracker.getJobIdsForGroup(group))
    spark.sparkContext.setJobGroup(group + "1", "jobs of one model")
    regression.fit_family(rows, "y", {"a": specs["a"]})
    one = len(tracker.getJobIdsForGroup(group + "1"))
    assert many <= one + 2  # a stage more of adaptive execution at most, not one job per group or model


def test_newey_west_equals_loops(rows, toy):
    fit = regression.newey_west(rows, "y", XS, None)
    d = dense(toy, XS, "swar")
    lags = int(math.floor(toy.groupby("nis_rad").size().max() ** 0.25))
    assert fit.extra["lags"] == lags
    u = d["x"] * d["e"][:, None]
    meat = np.zeros((4, 4))
    for i in toy.nis_rad.unique():
        part = u[(toy.nis_rad == i).values]
        meat += part.T @ part
        for lag in range(1, lags + 1):
            cross = part[lag:].T @ part[:-lag]
            meat += (1 - lag / (lags + 1)) * (cross + cross.T)
    assert np.allclose(fit.covariance, d["v"] @ meat @ d["v"])


def test_lags_need_unique_periods_and_stay_within_customers(spark, rows):
    df = spark.createDataFrame([(1, 1, 5.0), (1, 3, 6.0), (2, 2, 7.0)], "nis_rad long, Nof_Mths int, v double")
    got = regression.lag_within(df, ["v"]).orderBy("nis_rad", "Nof_Mths").collect()
    assert [r.v_lag for r in got] == [None, 5.0, None]
    with pytest.raises(ValueError):
        regression.newey_west(rows.union(rows), "y", XS, None)


def test_cochrane_orcutt_equals_single_steps(rows, toy):
    found = regression.cochrane_orcutt(rows, "y", ["x1", "x2"])
    d = dense(toy, ["x1", "x2"], "swar")
    assert np.allclose(found["original"].coefficients, d["b"])
    step = toy.assign(e=d["e"])
    by = step.groupby("nis_rad")
    step["e_lag"] = by.e.shift(1)
    aux = dense(step.dropna().assign(y=step.e), ["e_lag", "x1", "x2"], "swar")
    assert np.isclose(found["rho"], aux["b"][1])
    moved = toy.copy()
    for c in ("y", "x1", "x2"):
        moved[c] = toy[c] - found["rho"] * toy.groupby("nis_rad")[c].shift(1)
    last = dense(moved.dropna(), ["x1", "x2"], "swar")
    assert np.allclose(found["transformed"].coefficients, last["b"])


def test_mundlak_and_two_stage(rows, toy):
    fit = regression.mundlak(rows, "y", ["x1", "x2"], ["z"])
    means = toy.groupby("nis_rad")[["x1", "x2"]].transform("mean")
    frame = toy.assign(x1=toy.x1 - means.x1, x2=toy.x2 - means.x2, x1_mean=means.x1, x2_mean=means.x2)
    expected = dense(frame, ["x1", "x2", "z", "x1_mean", "x2_mean"], "walhus")
    assert np.allclose(fit.coefficients, expected["b"])
    within = regression.panel_fit(rows, "y", XS, "within")
    effects = regression.fixed_effects(rows, within, "y", XS).toPandas().set_index("nis_rad").FE
    m = toy.groupby("nis_rad").mean()
    assert np.allclose(effects.sort_index(), m.y - m[["x1", "x2"]] @ within.coefficients[:2])


def test_demeaned_columns_sum_to_zero(rows):
    sums = panel.demean_within(rows, ["x1"]).groupBy("nis_rad").agg(F.sum("x1").alias("s"))
    assert sums.filter("abs(s) > 1e-9").count() == 0


def test_p_values():
    # Student t with 1 and 2 degrees of freedom have closed forms.
    for t in (0.3, 1.0, 4.0):
        assert np.isclose(tails.student_p(t, 1), 1 - 2 / math.pi * math.atan(t))
        assert np.isclose(tails.student_p(t, 2), 1 - t / math.sqrt(2 + t * t))
    assert np.isclose(tails.student_p(1.96, 1e6), tails.normal_p(1.96), atol=1e-5)


def test_dummy_models(spark):
    rng = np.random.default_rng(12)
    data = []
    for i in range(40):
        place = "Urban" if i % 2 else "Rural"
        for t in range(6):
            v = rng.normal(size=7)
            data.append((i, t, place, 2010 + i % 3, float(v[0]), *map(float, v[1:7] + 5), float(rng.random())))
    names = ["csmo_fact", "total_structs", "min_dist2_road", "fsp", "population", "Night_Lights", "GDP", "Electrification"]
    schema = "nis_rad long, Nof_Mths int, rural_urban string, Year_of_connection int, " + ", ".join(f"{n} double" for n in names)
    df = panel.median_dummies(spark.createDataFrame(data, schema)).persist()
    effects = regression.dummy_effects(df)
    assert set(effects) == {"Electrification", "dist2_road", "population", "structs", "NL", "fsp"}
    assert "min_dist2_road" not in effects["dist2_road"].terms
    assert effects["dist2_road"].terms[-1] == "min_dist2_road_dummyHigh"
    halves = regression.subsamples(df)
    assert halves["NL.low"].n + halves["NL.high"].n == 240
    low = df.filter(F.col("Night_Lights_dummy") == "Low")
    xs = ["fsp", "min_dist2_road", "population", "total_structs", "GDP"]
    assert np.allclose(halves["NL.low"].coefficients,
                       regression.panel_fit(low, "csmo_fact", xs, "random", "walhus").coefficients)
    crossed = regression.interactions(df)
    assert crossed["population_x_structs"].terms[-1] == "population_dummyHigh:total_structs_dummyHigh"
    table = regression.coefficient_table(spark, effects)
    assert {"fsp", "NL"} <= set(regression.compare(table).columns)


def test_models_read_a_written_panel(spark):
    """Their many passes over the panel find it written and make it from the bills no more than once."""
    months = spark.range(48).select(
        (F.col("id") % 4).alias("nis_rad"),
        F.floor(F.col("id") / 4).cast("int").alias("Nof_Mths"),
        F.when(F.col("id") % 4 < 2, "Urban").otherwise("Rural").alias("rural_urban"),
        F.lit(2014).alias("Year_of_connection"),
        *[
            (F.col("id") * factor % 11).cast("double").alias(name)
            for factor, name in enumerate(
                ["csmo_fact", "min_dist2_road", "SACCO", "population", "total_structs", "Night_Lights", "GDP"], 3
            )
        ],
        (F.col("id") % 5 / 10).alias("Electrification"),
    )
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    dummied = model_queries._dummied(lambda name: months.distinct())
    assert dummied.count() == 48 and "Aggregate" not in plan(dummied)
    scaled = analysis._scaled_once({"combined": panel.standardize(panel.prepare_panel(months))})
    assert scaled["urban"].count() == 24 and "Aggregate" not in plan(scaled["urban"]) + plan(scaled["combined"])
