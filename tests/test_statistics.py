import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridpanel.operators import (
    clustering,
    curves,
    distributions,
    growth,
    order_stats,
    panel,
    quality,
    segments,
)


@pytest.fixture(scope="module")
def values():
    rng = np.random.default_rng(4)
    group = rng.choice(["a", "b", None], 3000, p=[0.7, 0.2, 0.1])
    value = np.where(rng.random(3000) < 0.3, 1.5, rng.normal(size=3000).round(3))
    frame = pd.DataFrame({"g": group, "v": value})
    frame.loc[::50, "v"] = np.nan
    return frame


def spark_frame(spark, frame):
    df = spark.createDataFrame(frame)
    return df.withColumn("v", F.when(~F.isnan("v"), F.col("v")))


def test_quantiles_equal_pandas(spark, values):
    probs = {"lo": 0.0, "q": 0.25, "m": 0.5, "z": 0.95, "hi": 1.0}
    df = spark_frame(spark, values)
    got = order_stats.exact_quantiles(df, "v", probs, ["g"])
    rows = {r.g: r for r in got.collect()}
    assert set(rows) == {"a", "b", None}
    for name, part in values.groupby("g", dropna=False):
        row = rows[None if pd.isna(name) else name]
        for out, p in probs.items():
            assert np.isclose(row[out], part.v.quantile(p))
    whole = order_stats.exact_quantiles(df, "v", probs).first()
    assert np.isclose(whole.z, values.v.quantile(0.95))


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([], "g string, v double")
    assert order_stats.exact_quantiles(df, "v", {"m": 0.5}, ["g"]).count() == 0
    whole = order_stats.exact_quantiles(df, "v", {"m": 0.5}).collect()
    assert [r.m for r in whole] == [None]


def test_quantiles_of_extreme_values(spark):
    """Values of any size and sign, equal or one unit in the last place apart."""
    rng = np.random.default_rng(7)
    tiny = np.nextafter(1.0, 2.0)
    parts = [
        rng.normal(size=400) * 10.0 ** rng.integers(-300, 300, 400),
        [0.0, -0.0, 1.0, tiny, -1.0, -tiny, 5e-324, -5e-324, 1.7e308, -1.7e308],
        np.full(90, 1.0),
        np.full(80, tiny),
    ]
    frame = pd.DataFrame({"v": np.concatenate(parts)})
    probs = {f"p{i}": i / 40 for i in range(41)}
    got = order_stats.exact_quantiles(spark.createDataFrame(frame), "v", probs).first()
    for name, p in probs.items():
        assert np.isclose(got[name], frame.v.quantile(p), rtol=1e-12), name
    cum = order_stats.cumulative_counts(spark.createDataFrame(frame), "v").toPandas().sort_values("v")
    assert (cum.n.cumsum() == cum.cum).all() and cum.cum.iloc[-1] == len(frame)


def test_large_and_small_groups_take_one_path(spark):
    """Nothing runs before the result is asked for, and the plan doesn't depend on the data."""
    def plan(rows):
        df = spark.range(rows).select((F.col("id") % 7).alias("g"), F.rand(1).alias("v"))
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
        made = order_stats.exact_quantiles(df, "v", {"m": 0.5}, ["g"])
        assert spark.sparkContext.statusTracker().getJobIdsForGroup(None) == jobs
        text = made._jdf.queryExecution().optimizedPlan().toString()
        return [line.strip(" :+-").split(" ")[0] for line in text.splitlines()]

    assert plan(70) == plan(10**6)


def test_grouped_statistics_equal_pandas(spark, values):
    stats = {"r": "rows", "c": "count", "a": "mean", "s": "std", "lo": "min", "hi": "max"}
    got = order_stats.grouped_statistics(spark_frame(spark, values), "v", ["g"], {"m": 0.5}, stats)
    rows = {r.g: r for r in got.collect()}
    for name, part in values.groupby("g", dropna=False):
        row = rows[None if pd.isna(name) else name]
        assert (row.r, row.c) == (len(part), part.v.count())
        expected = [part.v.mean(), part.v.std(), part.v.min(), part.v.max(), part.v.median()]
        assert np.allclose([row.a, row.s, row.lo, row.hi, row.m], expected)


def test_cumulative_counts_and_ranks(spark, values):
    df = spark_frame(spark, values)
    cum = order_stats.cumulative_counts(df, "v", ["g"]).toPandas()
    for name, part in values.dropna(subset=["v"]).groupby("g", dropna=False):
        counts = part.v.value_counts().sort_index()
        mine = cum[cum.g.isna() if pd.isna(name) else cum.g == name].sort_values("v")
        assert (mine.cum.values == counts.cumsum().values).all()
        assert (mine.total == counts.sum()).all()
    ranks = order_stats.average_ranks(df, "v", "r").toPandas().set_index("v").r
    known = values.v.dropna()
    assert np.allclose(known.rank().values, ranks.loc[known.values].values)


def test_ecdf_denominators(spark):
    df = spark.createDataFrame([("x", 1.0), ("x", 2.0), ("x", None), (None, 3.0)], "g string, v double")
    ends = {
        d: distributions.ecdf(df, "v", "g", d).agg(F.max("cdf")).first()[0] for d in ("all", "non_null")
    }
    assert np.isclose(ends["all"], 2 / 3) and ends["non_null"] == 1.0
    assert np.isclose(distributions.ecdf(df, "v").agg(F.max("cdf")).first()[0], 3 / 4)


def test_histogram_counts_every_row(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(30)] + [("b", 29.0)], "g string, v double")
    bars = distributions.histogram(df, "v", by="g").collect()
    assert sum(r["count"] for r in bars if r.g == "a") == 30
    assert sum(r["count"] for r in bars if r.g == "b") == 1
    assert len(bars) == 60 and all(np.isclose(r.high - r.low, 1.0) for r in bars)
    for r in bars:
        # Bins are centred on whole numbers here, one value each.
        assert r["count"] == (1 if r.g == "a" or r.high == 29.5 else 0)


def test_growth_attach_and_thresholds(spark):
    rows = [(1, 1, 10.0), (2, 1, 20.0), (3, 2, 5.0), (4, None, 7.0)]
    df = spark.createDataFrame(rows, "nis_rad long, Nof_Mths int, csmo_fact double")
    curve = {r.Nof_Mths: r for r in growth.growth_curve(df).collect()}
    assert curve[1].Median == 15.0 and curve[1].Qrtl1 == 12.5 and set(curve) == {1, 2}
    assert growth.growth_curve(df, min_count=2).count() == 1
    attached = {r.nis_rad: r.Median for r in growth.growth_curve(df, attach=True).collect()}
    assert attached == {1: 15.0, 2: 15.0, 3: 5.0, 4: None}


def test_segments_without_label_or_bills(spark):
    bills = spark.createDataFrame([(1, 2.0), (1, 4.0), (2, 9.0)], "nis_rad long, csmo_fact double")
    labels = spark.createDataFrame(
        [(1, "x"), (5, "x"), (2, None), (6, "empty")], "nis_rad long, segment string"
    )
    got = segments.segment_report(bills, labels).collect()
    assert [(r.segment, r.customer_count, r.bill_count, r.avg_consumption) for r in got] == [("x", 2, 2, 3.0)]
    stats = {r.nis_rad: r for r in segments.consumption_summary(bills).collect()}
    assert stats[2].Std_Kwh is None and stats[2].Mean_Kwh == 9.0 and stats[1].Count == 2


def test_tiers(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(1, 11)] + [(99, None)], "nis_rad long, Mean_Kwh double")
    tiers = {r.nis_rad: r.segment for r in segments.consumption_tiers(df).collect()}
    cuts = pd.Series(np.arange(1.0, 11)).quantile([0.33, 0.67]).values
    for i in range(1, 11):
        assert tiers[i] == ("Low" if i <= cuts[0] else "Medium" if i <= cuts[1] else "High")
    assert tiers[99] is None


def test_median_ties_and_missing_locations(spark):
    rows = [("Urban", v, v) for v in (1.0, 2.0, 3.0)] + [("Rural", 10.0, 10.0), (None, 0.0, 0.0), ("Urban", None, None)]
    df = spark.createDataFrame(rows, "rural_urban string, population double, min_dist2_road double")
    got = {
        (r.rural_urban, r.population): (r.population_dummy, r.min_dist2_road_dummy)
        for r in panel.median_dummies(df).collect()
    }
    assert got[("Urban", 1.0)] == ("Low", "High")
    assert got[("Urban", 2.0)] == ("High", "Low")
    assert got[("Rural", 10.0)] == ("High", "Low")
    assert got[(None, 0.0)] == ("High", "Low") and got[("Urban", None)] == ("High", "Low")


def test_panel_cleaning(spark):
    df = spark.createDataFrame(
        [(1, 1.0, None, 2.0, None, -3.0, 0.5), (2, 1.0, 1.0, 2.0, 5.0, 4.0, 0.5), (2, 1.0, 1.0, 2.0, 5.0, 4.0, 1.2)],
        "nis_rad long, min_dist2_road double, SACCO double, commercial_bank double, total_structs double,"
        " Night_Lights double, Electrification double",
    )
    row = panel.prepare_panel(df).collect()
    assert len(row) == 1
    assert (row[0].fsp, row[0].total_structs, row[0].Night_Lights) == (2.0, 0.0, 0.0)
    assert np.isclose(row[0].min_dist2_road, 111.32) and row[0].Electrification == 50.0


def test_sample_sizes_follow_the_targets(spark):
    rows = []
    for i in range(300):
        place = "Rural" if i % 3 else "Urban"
        rows += [(i, place, 2010 + i % 4, m, 1.0) for m in range(1, 4)]
    rows += [(1000, "Rural", 2010, 1, 1.0), (1000, "Rural", 2010, 9, 1.0), (1001, "Rural", 2010, 1, None)]
    df = spark.createDataFrame(rows, "nis_rad long, rural_urban string, Year_of_connection int, Nof_Mths int, GDP double")
    sample = panel.balanced_sample(df, 100, 0.59)
    again = panel.balanced_sample(df.repartition(7), 100, 0.59)
    ids = {r.nis_rad for r in sample.select("nis_rad").distinct().collect()}
    assert ids == {r.nis_rad for r in again.select("nis_rad").distinct().collect()}
    assert 1000 not in ids and 1001 not in ids
    # 200 rural customers, 50 per year: a quarter of 59 each, 14.75, rounds to 15.
    counts = sample.groupBy("rural_urban", "Year_of_connection").agg(F.count_distinct("nis_rad").alias("n"))
    assert {r.n for r in counts.collect() if r.rural_urban == "Rural"} == {15}
    assert {r.n for r in counts.collect() if r.rural_urban == "Urban"} == {10}
    assert sample.groupBy("nis_rad").count().filter("count <> 3").count() == 0


def test_hash_sample_cuts_inside_a_part(spark):
    df = spark.range(5000).withColumn("s", F.lit("one"))
    for take in (0, 1, 777, 5000):
        kept = order_stats.smallest_by_hash(df, ["s"], "id", F.lit(take), 3, split_bits=4)
        assert kept.count() == take


def test_standardize_constants_and_labels(spark):
    df = spark.createDataFrame([(1, 1.0, 5.0), (2, 3.0, 5.0)], "nis_rad long, x double, c double")
    got = {r.nis_rad: (r.x, r.c) for r in panel.standardize(df).collect()}
    assert np.isclose(got[1][0], -np.sqrt(0.5)) and got[1][1] == 0.0


def test_combined_dummy_levels(spark):
    df = spark.createDataFrame([("Low", "High"), ("High", None)], "a string, b string")
    label = segments.combined_dummy("fsp_dummy", "NL_dummy", F.col("a"), F.col("b"))
    assert [r[0] for r in df.select(label).collect()] == ["Low_fsp_High_NL", None]


def test_validation_counts_gaps_as_a_value(spark):
    df = spark.createDataFrame([(1, 1, 2.0), (1, 2, None), (2, 1, 3.0), (None, 2, 4.0)], "nis_rad long, Nof_Mths int, v double")
    found = quality.validate_panel(df)
    row = found["structure"].first()
    assert (row.n_individuals, row.n_time_periods, row.n_observations, row.is_balanced) == (3, 2, 4, False)
    assert {(r.variable, r.missing_count) for r in found["missing"].collect()} == {("nis_rad", 1), ("v", 1)}


def test_outlier_rate_is_over_all_rows(spark):
    data = [float(i) for i in range(20)] + [1000.0, None]
    df = spark.createDataFrame([(v,) for v in data], "v double")
    row = quality.detect_outliers(df).first()
    assert row.n_outliers == 1 and np.isclose(row.outlier_rate, 1 / 22)


@pytest.mark.parametrize("method", ["pearson", "spearman"])
def test_correlations_equal_pandas(spark, method):
    rng = np.random.default_rng(6)
    x = rng.integers(0, 20, 400).astype(float)
    frame = pd.DataFrame({"x": x, "y": -x + rng.normal(size=400), "z": rng.normal(size=400), "k": 3.0})
    got = quality.correlations(spark.createDataFrame(frame), ["x", "y", "z", "k"], method).collect()
    expected = frame.corr(method=method)
    for r in got:
        if "k" in (r.var1, r.var2):
            assert r.correlation is None
        else:
            assert np.isclose(r.correlation, expected.loc[r.var1, r.var2])
    known = [abs(r.correlation) for r in got if r.correlation is not None]
    assert known == sorted(known, reverse=True) and len(got) == 12


def test_report_text(spark, tmp_path):
    from gridpanel.sources.sinks import write_report

    rows = [(i % 5, i // 5, "Urban" if i % 5 < 2 else "Rural", float(i), 2.0 * i + (i % 3)) for i in range(50)]
    df = spark.createDataFrame(rows, "nis_rad long, Nof_Mths int, rural_urban string, a double, b double")
    report = quality.quality_report(df)
    write_report(report, str(tmp_path / "report"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "report")).collect()]
    assert lines[0] == "Data Quality Report"
    assert "Data Dimensions: 50 rows x 5 columns" in lines and "- Balanced: TRUE" in lines
    assert any(line.startswith("a b 0.99") for line in lines)
    assert "Missing Data:" not in lines
    square = quality.correlation_matrix(report["correlations"]).collect()
    assert [r["a"] for r in square if r.var1 == "a"] == [1.0]


def test_one_cluster_and_falling_scores(spark):
    rng = np.random.default_rng(7)
    xy = np.concatenate([rng.normal(size=(60, 2)), rng.normal(size=(60, 2)) + 12])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(xy)], "nis_rad long, x double, y double")
    scores, labels = clustering.kmeans_scan(df, ["x", "y"], ks=[1, 2, 3])
    score = {r.k: r.score for r in scores.collect()}
    assert np.isclose(score[1], -240.0) and score[1] < score[2] <= score[3]
    two = labels.filter("k = 2").toPandas().sort_values("nis_rad").label.values
    assert len(set(two[:60])) == 1 and len(set(two[60:])) == 1 and two[0] != two[60]
    assert set(labels.filter("k = 1").toPandas().label) == {0}


def test_decay_recovers_its_parameters(spark):
    rng = np.random.default_rng(9)
    x = np.arange(1, 121).repeat(10)
    rows = []
    for name, (a, b, c) in {"p": (80.0, 0.05, 30.0), "q": (-50.0, 0.2, 90.0)}.items():
        y = a * np.exp(-b * x) + c + rng.normal(size=x.size) * 0.5
        rows += [(name, int(i), float(v)) for i, v in zip(x, y)]
    rows += [("flat", i, 4.0) for i in range(3)]
    df = spark.createDataFrame(rows, "s string, Nof_Mths int, csmo_fact double")
    fits = curves.fit_decay(df, by=["s"])
    got = {r.s: r for r in fits.collect()}
    assert np.allclose([got["p"].a, got["p"].b, got["p"].c], [80, 0.05, 30], rtol=0.02)
    assert np.allclose([got["q"].a, got["q"].b, got["q"].c], [-50, 0.2, 90], rtol=0.02)
    assert got["flat"].a is None and got["flat"].n == 3
    # Covariance and fit against numpy.
    p = df.filter("s = 'p'").toPandas()
    a, b, c = got["p"].a, got["p"].b, got["p"].c
    e = np.exp(-b * p.Nof_Mths.values)
    jac = np.column_stack([e, -a * p.Nof_Mths.values * e, np.ones(len(p))])
    fitted = a * e + c
    ss = ((fitted - p.csmo_fact) ** 2).sum()
    cov = np.linalg.inv(jac.T @ jac) * ss / (len(p) - 3)
    assert np.allclose([got["p"].cov_aa, got["p"].cov_bc], [cov[0, 0], cov[1, 2]], rtol=1e-4)
    assert np.isclose(got["p"].r_squared, 1 - ss / ((fitted - p.csmo_fact.mean()) ** 2).sum(), rtol=1e-6)
    fitted_rows = curves.fitted_curve(df, fits, by=["s"]).filter("s = 'p'").toPandas()
    assert np.allclose(np.sort(fitted_rows.fitted), np.sort(fitted))


def test_fast_decay_beside_a_long_range(spark):
    """One far x, in another group or in its own, does not keep a fast decay from being found."""
    rows = [("far", float(i), float(80 * np.exp(-0.001 * i) + 5)) for i in range(0, 3001, 10)]
    for name, rate in {"fast": 1.5, "steep": 0.7}.items():
        rows += [(name, float(i), float(60 * np.exp(-rate * i) + 20)) for i in range(1, 61)]
    rows += [("steep", 3000.0, 20.0)]
    df = spark.createDataFrame(rows, "s string, Nof_Mths double, csmo_fact double")
    got = {r.s: r for r in curves.fit_decay(df, by=["s"]).collect()}
    assert all(got[s].converged for s in ("far", "fast", "steep"))
    assert np.allclose([got[s].b for s in ("far", "fast", "steep")], [0.001, 1.5, 0.7], rtol=1e-4)
    assert np.allclose([got[s].a for s in ("far", "fast", "steep")], [80, 60, 60], rtol=1e-3)


def test_order_keys_follow_the_doubles(spark):
    rng = np.random.default_rng(5)
    bits = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    odd = [0.0, 5e-324, -5e-324, 2.0**-1022, 1.0, 2.0, 1.9999999999999998, 1.7976931348623157e308, np.inf, -np.inf]
    values = np.concatenate([bits.view(np.float64), -bits.view(np.float64), odd, 2.0 ** np.arange(-1074, 1024)])
    values = np.unique(values[~np.isnan(values)] + 0.0)
    df = spark.createDataFrame(pd.DataFrame({"x": values}))
    got = df.select("x", order_stats.order_key(F.col("x")).alias("k")).toPandas().sort_values("x")
    whole = np.where(got.x < 0, -np.abs(got.x.values).view(np.int64), np.abs(got.x.values).view(np.int64))
    assert (got.k.values == whole).all()


def test_close_values_are_split_until_few_are_sorted_together(spark, monkeypatch):
    monkeypatch.setattr(order_stats, "FULL", 64)
    values = 1e12 + np.arange(5000)
    df = spark.createDataFrame(pd.DataFrame({"g": ["a"] * 5000 + ["b"] * 3, "x": [*values, 1.0, 2.0, 4.0]}))
    probs = {"q1": 0.25, "q2": 0.5, "q3": 0.9}
    got = {r.g: r for r in order_stats.exact_quantiles(df, "x", probs, ["g"]).collect()}
    for name, p in probs.items():
        assert got["a"][name] == np.quantile(values, p)
        assert got["b"][name] == pytest.approx(np.quantile([1.0, 2.0, 4.0], p))
    cum = order_stats.cumulative_counts(df.filter("g = 'a'"), "x").toPandas().sort_values("x")
    assert (cum["cum"].values == np.arange(1, 5001)).all()
    # What is sorted together shares all but 18 bits, or is a digit that is not full.
    keys = df.withColumn("k", order_stats.order_key(F.col("x")))
    fullest = keys.groupBy(F.shiftright("k", order_stats.LAST)).count().agg(F.max("count")).first()[0]
    assert fullest <= 1 << 18


def test_deviation_of_large_close_values(spark):
    values = 1e12 + np.arange(2000)
    df = spark.createDataFrame(pd.DataFrame({"x": values}))
    got = order_stats.grouped_statistics(df, "x", [], {"m": 0.5}, {"s": "std", "a": "mean"}).first()
    assert got.s == pytest.approx(np.std(values, ddof=1), rel=1e-6) and got.a == values.mean()


def joins_of(df):
    """Kinds of joins in the plan before it runs, as Spark chooses them from the sizes of files."""
    plan = df._jdf.queryExecution().sparkPlan().toString()
    return set(re.findall(r"(BroadcastHash|SortMerge|ShuffledHash)Join", plan))


def test_counts_of_a_small_file_are_not_broadcast(spark, tmp_path):
    rows = [("a", float(i)) for i in range(5)] + [("b", 7.0), (None, 1.0)]
    spark.createDataFrame(rows, "g string, v double").write.parquet(str(tmp_path / "t"))
    read = spark.read.parquet(str(tmp_path / "t"))
    found = order_stats.exact_quantiles(read, "v", {"m": 0.5}, ["g"])
    assert joins_of(found) == {"SortMerge"}
    assert {(r["g"], r["m"]) for r in found.collect()} == {("a", 2.0), ("b", 7.0), (None, 1.0)}
    assert joins_of(quality.correlations(read.withColumn("w", F.col("v") * 2), ["v", "w"], "spearman")) == {"SortMerge"}


def test_segments_of_tiers_keep_their_plan_small(spark):
    bills = spark.createDataFrame([(i, 3, float(i)) for i in range(1, 11)], "nis_rad long, Nof_Mths int, csmo_fact double")
    tiers = segments.consumption_tiers(segments.consumption_summary(bills))
    assert len(tiers._jdf.queryExecution().analyzed().toString().splitlines()) < 40
    report = {r.segment: (r.customer_count, r.median_consumption) for r in segments.segment_report(bills, tiers).collect()}
    assert report == {"Low": (3, 2.0), "Medium": (4, 5.5), "High": (3, 9.0)}


def test_rounds_of_clustering_take_few_tasks(spark):
    df = spark.createDataFrame([(i, float(i), float(i % 3)) for i in range(30)], "nis_rad long, a double, b double").repartition(64)
    _, labels = clustering.kmeans_scan(df, ["a", "b"], ks=[1])
    assert labels.rdd.getNumPartitions() < 64 and labels.count() == 30
