import datetime as dt

import pytest
from pyspark.sql import functions as F

from gridpanel.functions import dates, scalars
from gridpanel.operators import cleaning
from gridpanel.plans import features as plan
from gridpanel.sources import readers, sinks


def test_missing_coordinates_are_dropped(spark):
    df = spark.createDataFrame(
        [(1, -1.0, 36.0), (2, None, 36.0), (3, -1.0, None)], "nis_rad long, LAT double, LON double"
    )
    clean = cleaning.clean_locations(df)
    assert clean.columns == ["NIS_RAD", "LAT", "LON"]
    assert [r.NIS_RAD for r in clean.collect()] == [1]


def test_bills_lose_duplicates_outliers_and_gaps(spark):
    rows = [(1, "03/04/2015", "2015-04-01", float(v)) for v in range(1, 21)]
    rows += [(1, "03/04/2015", "2015-04-01", 1.0), (2, "31/12/2015", "2015-12-31", None)]
    df = spark.createDataFrame(rows, "nis_rad long, f_fact string, period string, csmo_fact double")
    clean = cleaning.clean_bills(df).collect()
    # 20 distinct values: the 0.95 quantile is 19.05.
    assert sorted(r.csmo_fact for r in clean) == [float(v) for v in range(1, 20)]
    assert {r.f_fact for r in clean} == {dt.datetime(2015, 4, 3)}
    assert {r.period for r in clean} == {dt.datetime(2015, 4, 1)}


def test_day_first_dates(spark):
    df = spark.createDataFrame([("05/02/2014",), ("5-2-2014",), ("soon",), (None,)], "d string")
    parsed = [r.p for r in df.select(dates.parse_day_first(df, "d").alias("p")).collect()]
    assert parsed == [dt.datetime(2014, 2, 5), dt.datetime(2014, 2, 5), None, None]


def test_tenure_truncates_toward_zero(spark):
    locations = spark.createDataFrame([(1, "01/06/2015"), (2, None)], "NIS_RAD long, installation string")
    bills = spark.createDataFrame(
        [(1, dt.datetime(2015, 4, 16)), (1, dt.datetime(2016, 6, 1)), (2, dt.datetime(2016, 1, 1))],
        "nis_rad long, f_fact timestamp",
    )
    got = cleaning.add_tenure(bills, locations).orderBy("nis_rad", "f_fact").collect()
    assert [r.months_since_connection for r in got] == [-1, 12, None]


def test_coordinates_bounds_are_inclusive(spark):
    df = spark.createDataFrame(
        [(5.5, 33.5), (5.6, 33.5), (None, 34.0), (-91.0, 34.0)], "LAT double, LON double"
    )
    box = {"min_lat": -5.0, "max_lat": 5.5, "min_lon": 33.5, "max_lon": 42.0}
    assert cleaning.filter_valid(df, bounds=box).count() == 1
    assert cleaning.filter_valid(df).count() == 2
    assert cleaning.filter_valid(df, filter_valid=False).count() == 4


def test_bill_year_depends_on_columns_not_on_gaps(spark):
    both = spark.createDataFrame(
        [(None, dt.datetime(2012, 1, 1))], "year int, f_fact timestamp"
    )
    assert both.select(dates.bill_year(both)).first()[0] is None
    dated = spark.createDataFrame([(dt.datetime(2013, 1, 1),)], "date timestamp")
    assert dated.select(dates.bill_year(dated)).first()[0] == 2013
    assert dated.select(dates.bill_year(dated, allow_date=False)).first()[0] == 2015


def test_first_row_per_key(spark):
    df = spark.createDataFrame([(1, 3, "c"), (1, 2, "b"), (2, 9, "z")], "k long, o int, v string")
    got = cleaning.first_per_key(df, "k", ["o"]).orderBy("k").collect()
    assert [(r.k, r.v) for r in got] == [(1, "b"), (2, "z")]


def test_display_names(spark):
    df = spark.createDataFrame([("min_dist2_road",), ("fsp_dummy",), ("GDP",), ("mean_kwh",)], "n string")
    got = [r[0] for r in df.select(scalars.display_name(F.col("n"))).collect()]
    assert got == ["Min. Dist2 Road", "FSP Dummy", "GDP", "Mean kWh"]


def test_tables_round_trip_and_unknown_formats_fail(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan")), (2, 2.0)], "k long, v double")
    for kind in ("parquet", "csv"):
        path = str(tmp_path / f"t.{kind}")
        sinks.write_table(df, path)
        back = readers.read_table(spark, path, df.schema).orderBy("k").collect()
        assert [r.v for r in back] == [None, 2.0]
    with pytest.raises(ValueError):
        readers.read_table(spark, "t.pck")
    both = readers.read_existing(spark, [str(tmp_path / "t.parquet"), str(tmp_path / "no.parquet")])
    assert both.count() == 2
    assert readers.read_existing(spark, [str(tmp_path / "no.parquet")]) is None


def test_results_are_saved_and_loaded(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0)], "k long, v double")
    sinks.save_results({"summary_stats": df}, str(tmp_path), "run", timestamp=False)
    found = sinks.load_results(spark, str(tmp_path), prefix="run")
    assert list(found) == ["summary_stats"] and found["summary_stats"].count() == 1
    stamped = sinks.save_results({"models": df}, str(tmp_path), "run")
    assert stamped["models"].startswith(f"{tmp_path}/run_models_2")
    # Parts are found by the manifest, whatever their names and time stamps.
    parts = {"plot_median_consumption": df, "quality_outliers": df.limit(0)}
    sinks.save_results(parts, str(tmp_path), "run")
    found = sinks.load_results(spark, str(tmp_path), prefix="run")
    assert {name: part.count() for name, part in found.items()} == {"plot_median_consumption": 1, "quality_outliers": 0}
    assert list(sinks.load_results(spark, str(tmp_path), ["quality_outliers", "no"], "run")) == ["quality_outliers"]
    assert sinks.load_results(spark, str(tmp_path), prefix="other") == {}


def test_provider_dates(spark):
    df = spark.createDataFrame(
        [(1.0, 2.0, 2010, 3, 4, "a"), (1.0, 2.0, 0, 0, 0, "b")],
        "GPSLatitud double, GPSLongitu double, year int, month int, day int, factype string",
    )
    got = readers.providers(df)
    assert {"Lat", "Lon"} <= set(got.columns)
    assert {r.start_dte for r in got.collect()} == {dt.date(2010, 3, 4)}


def test_road_text(spark):
    df = spark.createDataFrame(
        [
            (1, "A", "LINESTRING (0 0, 1 1, 2 0)"),
            (2, "B", "MULTILINESTRING ((0 0, 1 0), (5 5, 6 5, 7 5))"),
            (3, "C", None),
        ],
        "road_id long, ROADCLASS string, geometry string",
    )
    got = readers.road_segments(df).orderBy("road_id", "part", "seg").collect()
    assert [(r.road_id, r.part, r.x1, r.y1, r.x2, r.y2) for r in got] == [
        (1, 0, 0.0, 0.0, 1.0, 1.0),
        (1, 0, 1.0, 1.0, 2.0, 0.0),
        (2, 0, 0.0, 0.0, 1.0, 0.0),
        (2, 1, 5.0, 5.0, 6.0, 5.0),
        (2, 1, 6.0, 5.0, 7.0, 5.0),
    ]


@pytest.mark.parametrize(
    "name, year",
    [
        ("d/SVDNB_npp_20150101-20151231_x.tif", 2015),
        ("d/lights_v1_2017x_y.tif", 2017),
        ("d/a_b_c.tif", 2015),
        ("d/plain.tif", 2015),
        ("d/SVDNB_npp_unknown_x.tif", None),
        ("d/SVDNB_2015.tif", None),
    ],
)
def test_lights_year(spark, name, year):
    df = spark.createDataFrame([(name,)], "p string")
    assert df.select(readers.lights_year(F.col("p"))).first()[0] == year


def test_assembly_keeps_rows_and_rejects_repeated_features(spark):
    bills = spark.createDataFrame(
        [(1, dt.datetime(2015, 1, 3)), (1, dt.datetime(2015, 1, 3)), (2, dt.datetime(2016, 1, 1))],
        "nis_rad long, f_fact timestamp",
    )
    locations = spark.createDataFrame([(1, -1.0, 36.0)], "NIS_RAD long, LAT double, LON double")
    feature = spark.createDataFrame([(1, 2015, 7)], "nis_rad long, year int, value int")
    table = plan.assemble_features(bills, locations, feature)
    assert sorted((r.nis_rad, r.value) for r in table.collect() if r.value) == [(1, 7), (1, 7)]
    assert table.count() == 3
    with pytest.raises(Exception, match="not unique"):
        plan.assemble_features(bills, locations, feature.union(feature)).collect()


@pytest.mark.parametrize("column", ["f_fact", "date"])
def test_bill_year_of_text(spark, column):
    df = spark.createDataFrame([("25/12/2015",), ("3-1-2016",), ("none",), (None,)], f"{column} string")
    assert [r[0] for r in df.select(dates.bill_year(df)).collect()] == [2015, 2016, None, None]
