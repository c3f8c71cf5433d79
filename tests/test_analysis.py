import pytest
from pyspark.sql import functions as F

from gridpanel.plans import analysis, features
from gridpanel.plans.stages import Stages
from gridpanel.session import temporary_tables, written
from registry.views import view


def test_quick_analysis(spark):
    sf = "/root/testdata/sf0.01"
    inputs = view(spark, sf, "features").persist(), view(spark, sf, "gcp").persist()
    run = analysis.quick_analysis(*inputs, sample_size=95)
    assert set(run.models) == {"pool_u", "pool_r", "re_u", "re_r", "fe_u", "fe_r"}
    assert "median_consumption" in run.plots and "interactions" not in run.plots
    parts = run.datasets["raw"]
    assert parts["urban"].count() + parts["rural"].count() == parts["combined"].count() > 0
    assert run.tables()["models"].count() == 46


def test_a_failed_run_goes_on_behind_its_last_stage(spark, tmp_path):
    store = Stages(spark, str(tmp_path / "run"))
    made = []

    def numbers():
        made.append("numbers")
        return {"small": spark.range(3), "large": spark.range(10)}

    def broken():
        made.append("broken")
        return {"good": spark.range(2), "bad": spark.range(2).select(F.raise_error(F.lit("no")).cast("int").alias("x"))}

    assert store.tables("numbers", numbers)["large"].count() == 10
    with pytest.raises(Exception, match="no"):
        store.tables("next", broken)
    assert store.committed("numbers") and not store.committed("next")
    # A rerun reads what is committed and makes the rest.
    again = Stages(spark, str(tmp_path / "run"))
    assert again.tables("numbers", numbers)["small"].count() == 3
    assert {n: t.count() for n, t in again.tables("next", lambda: {"good": spark.range(4)}).items()} == {"good": 4}
    assert made == ["numbers", "broken"]


def test_temporary_tables_go_at_the_commit(spark, tmp_path):
    before = temporary_tables()
    kept = Stages(spark, str(tmp_path / "run")).tables("s", lambda: {"t": written(spark.range(5))})
    assert temporary_tables() == before and kept["t"].count() == 5


def test_features_are_carried_across_blocks(spark):
    known = {("a", 0): (1.0, None), ("a", 3): (None, "x"), ("a", 200): (7.0, None), ("b", 5): (None, None)}
    times = {"a": [0, 1, 3, 4, 63, 64, 130, 199, 200, 300], "b": [4, 5, 70]}
    rows = [(k, t, *known.get((k, t), (None, None))) for k, ts in times.items() for t in ts]
    df = spark.createDataFrame(rows, "nis_rad string, Nof_Mths int, p double, q string").repartition(3)
    expected = {}
    for k, ts in times.items():
        last = (None, None)
        for t in ts:
            last = tuple(new if new is not None else old for new, old in zip(known.get((k, t), (None, None)), last))
            expected[k, t] = last
    for block in (2, 64, 1000):
        got = features.carry_forward(df, ["p", "q"], block=block).collect()
        assert {(r.nis_rad, r.Nof_Mths): (r.p, r.q) for r in got} == expected and len(got) == len(rows)
