import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridpanel.functions import clipping, scalars, spatial
from gridpanel.operators import proximity, pyramid, raster, roads

R500 = 500 / 110540


def half_planes(dx, dy, r):
    """Inside all 64 sides, each tested on its own."""
    angles = (np.arange(64) + 0.5) * 2 * np.pi / 64
    reach = np.outer(dx, np.cos(angles)) + np.outer(dy, np.sin(angles))
    return (reach < r * np.cos(np.pi / 64)).all(axis=1)


def cluster(rng, n, hot):
    """Points of which `hot` crowd into one place."""
    xy = np.column_stack([36 + rng.random(n) * 0.1, -1 + rng.random(n) * 0.1])
    xy[:hot] = [36.05, -0.95] + rng.normal(size=(hot, 2)) * 5e-4
    return xy


@pytest.fixture(scope="module")
def places():
    rng = np.random.default_rng(5)
    centers, points = cluster(rng, 120, 50), cluster(rng, 1500, 900)
    left = pd.DataFrame({"NIS_RAD": range(120), "LON": centers[:, 0], "LAT": centers[:, 1]})
    right = pd.DataFrame(
        {"pid": range(1500), "kind": rng.choice(list("ab"), 1500), "Lon": points[:, 0], "Lat": points[:, 1]}
    )
    # Copies of one place, and a center on the spot.
    right.loc[1400:, ["Lon", "Lat"]] = [36.02, -0.98]
    left.loc[119, ["LON", "LAT"]] = [36.02, -0.98]
    return left, right


@pytest.mark.parametrize("shape", ["circle", "polygon"])
@pytest.mark.parametrize("levels", [0, 1, 3])
def test_counts_equal_brute_force(spark, places, shape, levels):
    left, right = places
    got = (
        proximity.count_in_radius(
            spark.createDataFrame(left), spark.createDataFrame(right), 500, by="kind",
            shape=shape, pivot=True, levels=levels,
        )
        .toPandas()
        .sort_values("NIS_RAD")
    )
    dx = right.Lon.values[None] - left.LON.values[:, None]
    dy = right.Lat.values[None] - left.LAT.values[:, None]
    if shape == "circle":
        inside = np.sqrt(dx**2 + dy**2) <= R500
    else:
        inside = half_planes(dx.ravel(), dy.ravel(), R500).reshape(dx.shape)
    for kind in "ab":
        assert (got[kind].values == inside[:, (right.kind == kind).values].sum(axis=1)).all()


def test_pairs_equal_brute_force(spark, places):
    left, right = places
    pairs = proximity.points_in_buffer(
        spark.createDataFrame(left), spark.createDataFrame(right), 300,
        right_xy=("Lon", "Lat"), levels=2,
    ).toPandas()
    dx = right.Lon.values[None] - left.LON.values[:, None]
    dy = right.Lat.values[None] - left.LAT.values[:, None]
    inside = half_planes(dx.ravel(), dy.ravel(), 300 / 110540).reshape(dx.shape)
    expected = {(i, j) for i, j in zip(*np.nonzero(inside))}
    assert set(zip(pairs.NIS_RAD, pairs.pid)) == expected and len(pairs) == len(expected)


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("shape", ["circle", "polygon"])
def test_full_blocks_have_several_rows(spark, places, monkeypatch, shape):
    left, right = places
    monkeypatch.setattr(pyramid, "BLOCK_ITEMS", 16)
    sides = spark.createDataFrame(left), spark.createDataFrame(right)
    got = {r.NIS_RAD: r.n for r in proximity.count_in_radius(*sides, 500, shape=shape).collect()}
    pairs = proximity.points_in_buffer(*sides, 500, shape, right_xy=("Lon", "Lat")).groupBy("NIS_RAD").count().collect()
    dx = right.Lon.values[None] - left.LON.values[:, None]
    dy = right.Lat.values[None] - left.LAT.values[:, None]
    if shape == "circle":
        inside = np.sqrt(dx**2 + dy**2) <= R500
    else:
        inside = half_planes(dx.ravel(), dy.ravel(), R500).reshape(dx.shape)
    assert got == dict(enumerate(inside.sum(axis=1)))
    assert {r.NIS_RAD: r["count"] for r in pairs} == {i: n for i, n in got.items() if n}


def test_finer_cells_are_not_joined_with_centers(spark, places):
    """Cells below the blocks come along with them: no center is shuffled to each of its leaves."""
    left, right = (spark.createDataFrame(t) for t in places)
    for run in (
        lambda levels: proximity.count_in_radius(left, right, 500, levels=levels),
        lambda levels: proximity.points_in_buffer(left, right, 500, right_xy=("Lon", "Lat"), levels=levels),
    ):
        assert _plan(run(4)).count("Join ") == _plan(run(2)).count("Join ")


def test_polygon_column_equals_half_planes(spark):
    rng = np.random.default_rng(1)
    angle, share = rng.random(20000) * 2 * np.pi, 0.995 + rng.random(20000) * 0.01
    df = pd.DataFrame({"dx": np.cos(angle) * share, "dy": np.sin(angle) * share})
    got = spark.createDataFrame(df).select(
        spatial.in_buffer(F.col("dx"), F.col("dy"), 1.0).alias("i")
    ).toPandas().i.values
    assert (got == half_planes(df.dx.values, df.dy.values, 1.0)).all()


def test_rim_belongs_to_circle_not_to_polygon(spark):
    left = spark.createDataFrame([(1, 0.0, 0.0)], "NIS_RAD long, LON double, LAT double")
    right = spark.createDataFrame([("k", R500, 0.0)], "kind string, Lon double, Lat double")
    for shape, n in (("circle", 1), ("polygon", 0)):
        assert proximity.count_in_radius(left, right, 500, shape=shape).first().n == n


def test_far_points_leave_the_grid_as_it_is(spark):
    """A coordinate off the globe neither coarsens the cells nor changes a count, and is found itself."""
    rng = np.random.default_rng(12)
    right = pd.DataFrame({"kind": "k", "Lon": rng.normal(37, 0.05, 4000), "Lat": rng.normal(-1, 0.05, 4000)})
    left = pd.DataFrame({"NIS_RAD": range(60), "LON": rng.normal(37, 0.05, 60), "LAT": rng.normal(-1, 0.05, 60)})
    far = pd.DataFrame({"kind": ["k", "k"], "Lon": [5e7, 5e7], "Lat": [5e7, 5e7]})
    away = pd.DataFrame({"NIS_RAD": [99], "LON": [5e7], "LAT": [5e7]})

    def run(points):
        boxes = spark.createDataFrame(points).select(
            F.col("Lon").alias("_xlo"), F.col("Lat").alias("_ylo"), F.col("Lon").alias("_xhi"), F.col("Lat").alias("_yhi")
        )
        grid = pyramid.radius_grid(boxes, 500 / 110540)
        fullest = grid.items.groupBy("_ix", "_iy").count().agg(F.max("count")).first()[0]
        counts = proximity.count_in_radius(
            spark.createDataFrame(pd.concat([left, away])), spark.createDataFrame(points), 500
        )
        return fullest, {r.NIS_RAD: r.n for r in counts.collect()}

    fullest, counts = run(right)
    also, with_far = run(pd.concat([right, far]))
    assert also == fullest < 50
    assert with_far == {**counts, 99: 2} and counts[99] == 0


def test_own_place_skips_rows_without_coordinates(spark):
    """A second row of the customer without coordinates changes nothing, wherever it stands."""
    schema = "NIS_RAD long, LAT double, LON double, installation string"
    whole = [(1, -1.0, 37.0, "01/02/2010"), (2, -1.0, 37.001, "01/03/2010")]
    gap = [(1, None, None, "01/01/2010"), (1, None, 37.0, "01/01/2010")]
    bills = spark.createDataFrame([(1, "15/06/2010")], "nis_rad long, period string")
    none = spark.createDataFrame([], "tx_id long, LAT double, LON double")
    got = [
        proximity.electrified_structures(bills, spark.createDataFrame(rows, schema), none).first().electrified_structures
        for rows in (whole, gap + whole, whole + gap)
    ]
    assert got[0] == got[1] == got[2] == 2


def test_no_hits_and_no_points_give_zero(spark):
    left = spark.createDataFrame(
        [(1, 0.0, 0.0), (2, None, 0.0)], "NIS_RAD long, LON double, LAT double"
    )
    right = spark.createDataFrame([("k", 1.0, 1.0)], "kind string, Lon double, Lat double")
    wide = proximity.count_in_radius(left, right, 500, by="kind", pivot=True)
    assert [r.k for r in wide.collect()] == [0, 0]
    empty = right.filter("false")
    assert [r.n for r in proximity.count_in_radius(left, empty, 500).collect()] == [0, 0]


def brute_distance(left, seg):
    px, py = left.LON.values[:, None], left.LAT.values[:, None]
    dx, dy = (seg.x2 - seg.x1).values, (seg.y2 - seg.y1).values
    len2 = dx**2 + dy**2
    t = ((px - seg.x1.values) * dx + (py - seg.y1.values) * dy) / np.where(len2 > 0, len2, 1)
    t = np.clip(np.where(len2 > 0, t, 0), 0, 1)
    return np.hypot(px - seg.x1.values - t * dx, py - seg.y1.values - t * dy)


def brute_length(left, seg, r):
    """Clip by all sides with numpy, per center and segment."""
    angles = (np.arange(64) + 0.5) * 2 * np.pi / 64
    n = np.column_stack([np.cos(angles), np.sin(angles)])
    d = np.column_stack([seg.x2 - seg.x1, seg.y2 - seg.y1])
    out = np.zeros((len(left), len(seg)))
    for i, row in enumerate(left.itertuples()):
        a = np.column_stack([seg.x1 - row.LON, seg.y1 - row.LAT])
        speed, room = d @ n.T, r * np.cos(np.pi / 64) - a @ n.T
        with np.errstate(divide="ignore", invalid="ignore"):
            hit = room / speed
        lo = np.maximum(0, np.where(speed < 0, hit, -np.inf).max(axis=1))
        hi = np.minimum(1, np.where(speed > 0, hit, np.inf).min(axis=1))
        beside = ((speed == 0) & (room < 0)).any(axis=1)
        out[i] = np.where(beside, 0, np.maximum(0, hi - lo)) * np.hypot(d[:, 0], d[:, 1])
    return out


@pytest.fixture(scope="module")
def road_case():
    rng = np.random.default_rng(8)
    left = pd.DataFrame(cluster(rng, 60, 20), columns=["LON", "LAT"])
    left.insert(0, "NIS_RAD", range(60))
    start = cluster(rng, 700, 300)
    seg = pd.DataFrame({"ROADCLASS": rng.choice(list("ABC"), 700), "x1": start[:, 0], "y1": start[:, 1]})
    seg["x2"] = seg.x1 + rng.normal(size=700) * 0.004
    seg["y2"] = seg.y1 + rng.normal(size=700) * 0.004
    seg.loc[0, ["x2", "y2"]] = seg.loc[0, ["x1", "y1"]].values
    return left, seg


@pytest.mark.parametrize("leaf", [4, 64])
def test_nearest_segment_equals_brute_force(spark, road_case, leaf):
    left, seg = road_case
    far = pd.DataFrame({"NIS_RAD": [900], "LON": [38.0], "LAT": [3.0]})
    left = pd.concat([left, far], ignore_index=True)
    got = roads.nearest_segment_distance(
        spark.createDataFrame(left), spark.createDataFrame(seg), leaf_items=leaf
    ).toPandas().sort_values("NIS_RAD")
    assert np.allclose(got.distance_to_road.values, brute_distance(left, seg).min(axis=1), atol=1e-12)


def test_tree_splits_only_full_cells(spark):
    rng = np.random.default_rng(2)
    town = pd.DataFrame({"_xlo": 36.7 + rng.random(3000) * 0.01, "_ylo": -1.2 + rng.random(3000) * 0.01})
    town = town.assign(_xhi=town._xlo, _yhi=town._ylo)
    lone = pd.DataFrame({c: [v] for c, v in zip(pyramid.BOX, (-70.0, 10.0, -70.0, 10.0))})
    off = pd.DataFrame({c: [5e7] for c in pyramid.BOX})

    def leaves(frame):
        tree = pyramid.build_tree(spark.createDataFrame(frame), 16)
        kids = tree.split.select("_lvl", F.inline("_kids")).filter("leaf")
        held = pyramid.tree_items(tree, ["_xlo"]).join(kids.withColumnRenamed("cell", "_cell"), "_cell")
        return {(r._cell, r._lvl): r["count"] for r in held.groupBy("_cell", "_lvl").count().collect()}

    alone, both = leaves(town), leaves(pd.concat([town, lone, off]))
    assert sum(both.values()) == 3002 and max(both.values()) <= 16
    # Items far off have shallow leaves of their own and change nothing else.
    assert {k: v for k, v in both.items() if k in alone} == alone
    assert sorted(level for _, level in set(both) - set(alone)) == [0, 0]
    assert max(level for _, level in alone) > 3


def test_nearest_segment_across_cells(spark):
    """Roads through many cells, points near a rim or in cells without a road; no point is a row for each leaf or road near it."""
    rng = np.random.default_rng(6)
    side = 360 / 2**pyramid.PASSED_BITS
    start = np.array([36.6, -1.5]) + rng.random((60, 2)) * 30 * side
    seg = pd.DataFrame({"x1": start[:, 0], "y1": start[:, 1]})
    seg["x2"], seg["y2"] = seg.x1 + rng.normal(size=60) * 4 * side, seg.y1 + rng.normal(size=60) * 4 * side
    seg.loc[:9, "x2"], seg.loc[10:19, "y2"] = seg.x1, seg.y1
    column, row = np.floor((36.6 + 180) / side) + np.arange(40) % 30, np.floor((-1.5 + 180) / side) + np.arange(40) % 29
    rim = np.column_stack([column * side - 180, row * side - 180]) + (rng.random((40, 2)) - 0.5) * 1e-6
    points = np.concatenate([np.array([36.6, -1.5]) + rng.random((200, 2)) * 30 * side, rim])
    left = pd.DataFrame({"NIS_RAD": range(240), "LON": points[:, 0], "LAT": points[:, 1]})
    got = roads.nearest_segment_distance(spark.createDataFrame(left), spark.createDataFrame(seg))
    plan = _plan(got)
    found = got.toPandas().sort_values("NIS_RAD").distance_to_road.values
    assert np.allclose(found, brute_distance(left, seg).min(axis=1), rtol=0, atol=1e-12)
    assert "FlatMapCoGroupsInArrow" in plan


def test_nearest_segment_with_a_far_coordinate(spark, road_case):
    left, seg = road_case
    wild = pd.DataFrame({"ROADCLASS": ["A"], "x1": [5e7], "y1": [5e7], "x2": [5e7], "y2": [5e7 + 1]})
    got = roads.nearest_segment_distance(
        spark.createDataFrame(left), spark.createDataFrame(pd.concat([seg, wild])), leaf_items=8
    ).toPandas().sort_values("NIS_RAD")
    assert np.allclose(got.distance_to_road.values, brute_distance(left, seg).min(axis=1), atol=1e-12)
    none = roads.nearest_segment_distance(spark.createDataFrame(left), spark.createDataFrame(seg).limit(0)).collect()
    assert len(none) == len(left) and all(r.distance_to_road is None for r in none)


@pytest.mark.parametrize("levels", [1, 3])
def test_lengths_equal_brute_force(spark, road_case, levels):
    left, seg = road_case
    # A road drawn twice, the second time backwards, counts once.
    back = seg.head(30).rename(columns={"x1": "x2", "x2": "x1", "y1": "y2", "y2": "y1"})
    doubled = pd.concat([seg, seg.head(50), back[seg.columns]])
    got = roads.segment_length_in_buffer(
        spark.createDataFrame(left), spark.createDataFrame(doubled), 2000, levels=levels
    ).toPandas().sort_values("NIS_RAD")
    lengths = brute_length(left, seg, 2000 / 110540)
    for name in "AB":
        expected = lengths[:, (seg.ROADCLASS == name).values].sum(axis=1)
        assert np.allclose(got[f"road_class_{name}_length"].values, expected, atol=1e-12)
    total = got.road_class_A_length + got.road_class_B_length
    assert np.allclose(got.total_road_length, total)


def test_stretches_of_several_roads_count_once(spark):
    x0, y0, dx, dy = 36.75, -1.25, 3 / 1024, 4 / 1024  # exact in binary

    def piece(a, b, name="A"):
        return (name, x0 + a * dx, y0 + a * dy, x0 + b * dx, y0 + b * dy)

    rows = [piece(0, 2), piece(1, 3), piece(2, 1), piece(1, 1), piece(5, 6), piece(5.5, 6), piece(0, 1, "B")]
    rows.append(("A", x0, y0 + dx, x0 + dx, y0 + dx + dy))  # beside them
    df = spark.createDataFrame(rows, "ROADCLASS string, x1 double, y1 double, x2 double, y2 double")
    for pitch in (1.0, 0.0071):
        found = roads.merged_lines(df, pitch, ["ROADCLASS"]).toPandas()
        length = np.hypot(found.x2 - found.x1, found.y2 - found.y1).groupby(found.ROADCLASS).sum()
        assert length["A"] == pytest.approx(5 * np.hypot(dx, dy)) and length["B"] == pytest.approx(np.hypot(dx, dy))
        assert np.hypot(found.x2 - found.x1, found.y2 - found.y1).max() <= pitch * (1 + 1e-12)
    center = spark.createDataFrame([(1, x0, y0)], "NIS_RAD int, LON double, LAT double")
    got = roads.segment_length_in_buffer(center, df, 20000).first()
    assert got.road_class_A_length == pytest.approx(5 * np.hypot(dx, dy))


def test_quick_clip_equals_all_sides(spark):
    rng = np.random.default_rng(3)
    n = 20000
    at, far = rng.random(n) * 2 * np.pi, rng.random(n) * 1.3
    length, turn = 10 ** rng.uniform(-4, 0.6, n), rng.random(n) * 2 * np.pi
    df = pd.DataFrame({"i": range(n), "x1": far * np.cos(at), "y1": far * np.sin(at)})
    df["x2"], df["y2"] = df.x1 + length * np.cos(turn), df.y1 + length * np.sin(turn)
    for j, y in enumerate(np.linspace(0.99, 1.001, 500)):
        df.loc[j, ["x1", "y1", "x2", "y2"]] = [-1.0, y, 1.0, y]
    df = df.assign(px=0.0, py=0.0, r=1.0)
    rows, ends = spark.createDataFrame(df), ("x1", "y1", "x2", "y2")
    quick = spatial.with_clipped_length(rows, "q", "px", "py", "r", ends)
    # Lambdas are not compiled; a clip with them took some ten times as long.
    assert "lambda" not in _plan(quick)
    both = spatial.with_clipped_length(quick, "s", "px", "py", "r", ends, grazing=False)
    assert both.select(F.max(F.abs(F.col("q") - F.col("s")))).first()[0] < 1e-12


@pytest.mark.parametrize("cells", [1, 3, 16, 32])
def test_lengths_of_many_segments_equal_all_sides(cells):
    """Sums over cells equal a clip of each pair, along sides, upright and level, off the rim and for places among the segments."""
    rng = np.random.default_rng(4)
    n, r = 600, 500 / 110540
    turn = rng.random(n) * 2 * np.pi
    turn[:200] = (rng.integers(0, 64, 200) + 0.5) * 2 * np.pi / 64 + np.pi / 2
    turn[200:260] = rng.integers(0, 4, 60) * np.pi / 2
    length = np.where(rng.random(n) < 0.05, 0.0, rng.random(n) * r)
    seg = pd.DataFrame({"x1": 36.6 + rng.random(n) * r, "y1": -1.5 + rng.random(n) * r})
    seg["x2"], seg["y2"] = seg.x1 + length * np.cos(turn), seg.y1 + length * np.sin(turn)
    left = pd.DataFrame({"LON": 36.6 + (rng.random(200) * 5 - 2) * r, "LAT": -1.5 + (rng.random(200) * 5 - 2) * r})
    left.loc[0] = [np.nan, 0.0]
    seg.loc[n] = [36.6, -1.5, np.nan, -1.5]
    kind = rng.integers(0, 3, n + 1)
    got = clipping.buffer_lengths(seg.to_numpy().T, kind, 3, left.LON.values, left.LAT.values, r, cells)
    whole = brute_length(left.drop(0), seg.drop(n), r)
    expected = np.column_stack([whole[:, kind[:n] == k].sum(axis=1) for k in range(3)])
    assert np.allclose(got[1:], expected, rtol=0, atol=1e-12) and (got[0] == 0).all()
    assert (expected.max(axis=0) > 0).all() and (expected.min(axis=0) == 0).all()


def test_many_segments_are_handled_in_parts(monkeypatch):
    rng = np.random.default_rng(5)
    lines = np.concatenate([rng.random((2, 500)), rng.random((2, 500))])
    monkeypatch.setattr(clipping, "SEGMENTS", 40)
    parts = clipping._near_each_other(lines)
    assert sorted(np.concatenate(parts)) == list(range(500)) and max(p.size for p in parts) <= 40
    same = clipping._near_each_other(np.ones((4, 100)))
    assert sorted(np.concatenate(same)) == list(range(100)) and max(p.size for p in same) <= 40


def test_pairs_of_points_and_roads_are_no_rows(spark, road_case):
    """A road on the rim of a buffer is no row of its own for every point."""
    left, seg = (spark.createDataFrame(f) for f in road_case)
    plan = _plan(roads.segment_length_in_buffer(left, seg, 2000))
    assert "FlatMapCoGroupsInArrow" in plan


def test_road_features_by_kind(spark, road_case):
    left, seg = (spark.createDataFrame(f) for f in road_case)
    assert roads.road_features(left, seg, "distances").columns == ["NIS_RAD", "distance_to_road"]
    with pytest.raises(ValueError):
        roads.road_features(left, seg, "areas")
    none = roads.road_features(left, seg.filter("false"), "both").first()
    assert none.distance_to_road is None and none.total_road_length == 0.0


def test_duplicate_transformers_and_shared_places(spark):
    customers = spark.createDataFrame(
        [(1, 0.0, 0.0), (2, 0.0, 0.0), (3, 1.0, 1.0), (4, 1.0, 1.0)], "NIS_RAD long, LAT double, LON double"
    )
    tx = spark.createDataFrame([(1, 0.0, 0.0), (-1, 0.0, 0.0)], "tx_id long, LAT double, LON double")
    # Customers 1 and 2 match two transformers each; places (0, 0) by 2 and (1, 1) count once.
    assert proximity.count_structures(customers, tx).first()[0] == 4 + 2
    assert proximity.match_transformers(customers, tx).count() == 4


def test_structures_follow_the_calendar(spark):
    customers = spark.createDataFrame(
        [(1, 0.0, 0.0, "01/01/2015"), (2, 0.001, 0.0, "15/03/2015"), (3, 0.001, 0.0, "15/06/2015"),
         (4, 0.0, 0.001, "unknown"), (5, 9.0, 9.0, "01/01/2000")],
        "NIS_RAD long, LAT double, LON double, installation string",
    )
    tx = spark.createDataFrame([(3, 0.001, 0.0)], "tx_id long, LAT double, LON double")
    bills = spark.createDataFrame(
        [(1, f"2015-{m:02d}-01") for m in (1, 3, 6)] + [(1, "2014-12-01"), (77, "2015-01-01")],
        "nis_rad long, period string",
    )
    got = proximity.electrified_structures(bills, customers, tx)
    values = {(r.nis_rad, r.period.strftime("%Y-%m")): r.electrified_structures for r in got.collect()}
    # March: customer 2 stands on the transformer (1) and is a place of its own (1).
    assert values == {
        (1, "2014-12"): 0, (1, "2015-01"): 1, (1, "2015-03"): 3, (1, "2015-06"): 4, (77, "2015-01"): 0,
    }


def test_zonal_stats_of_nodata_are_zero(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 5.0, 5.0)], "NIS_RAD long, LON double, LAT double")
    pixels = spark.createDataFrame([(0.0, 0.0, -5.0), (0.001, 0.0, -1.0)], "lon_c double, lat_c double, value double")
    for row in raster.zonal_stats(points, pixels, 500, nodata=0).collect():
        assert all(row[s] == 0 for s in raster.ALL_STATS)


def test_zonal_stats_equal_numpy(spark):
    rng = np.random.default_rng(2)
    lon, lat = (a.ravel() for a in np.meshgrid(36 + np.arange(60) * 0.001, -1 + np.arange(60) * 0.001))
    pixels = pd.DataFrame({"lon_c": lon, "lat_c": lat, "value": rng.integers(-3, 50, lon.size).astype(float)})
    points = pd.DataFrame({"NIS_RAD": range(25), "LON": 36 + rng.random(25) * 0.06, "LAT": -1 + rng.random(25) * 0.06})
    got = raster.zonal_stats(
        spark.createDataFrame(points), spark.createDataFrame(pixels), [250, 500], nodata=0, max_valid=40, prefix="p_"
    ).toPandas().set_index("NIS_RAD")
    for p in points.itertuples():
        for size in (250, 500):
            near = half_planes(lon - p.LON, lat - p.LAT, size / 110540)
            v = pixels.value.values[near]
            v = v[(v >= 0) & (v <= 40)]
            row = got.loc[p.NIS_RAD]
            assert row[f"p_pixels_count_{size}m"] == v.size
            assert math.isclose(row[f"p_sum_{size}m"], v.sum())
            if v.size:
                assert math.isclose(row[f"p_median_{size}m"], np.median(v))
                assert math.isclose(row[f"p_std_{size}m"], v.std(), abs_tol=1e-9)


def test_pixel_rows_with_gaps_repeats_and_odd_values(spark):
    rng = np.random.default_rng(9)
    x, y = np.meshgrid(36.6 + np.arange(40) * 0.003, -1.3 + np.arange(40) * 0.003)
    pixels = pd.DataFrame({"lon_c": x.ravel(), "lat_c": y.ravel(), "value": 1e6 + rng.integers(-3, 9, 1600)})
    pixels = pixels[rng.random(1600) < 0.7]
    pixels = pd.concat([pixels, pixels.head(50), pixels.tail(9).assign(value=[np.nan, np.inf, -np.inf] * 3)])
    points = pd.DataFrame({"NIS_RAD": range(12), "LON": 36.6 + rng.random(12) * 0.12, "LAT": -1.3 + rng.random(12) * 0.12})
    points.loc[0, ["LON", "LAT"]] = pixels.iloc[0][["lon_c", "lat_c"]].values
    got = raster.zonal_stats(
        spark.createDataFrame(points), spark.createDataFrame(pixels), [700, 1500], nodata=0
    ).toPandas().sort_values("NIS_RAD")
    good = pixels[np.isfinite(pixels.value)]
    for size in (700, 1500):
        r = size / 110540
        for i, p in enumerate(points.itertuples()):
            dx, dy = good.lon_c - p.LON, good.lat_c - p.LAT
            step = 2 * np.pi / 64
            inside = np.hypot(dx, dy) * np.cos(np.mod(np.arctan2(dy, dx), step) - step / 2) < r * np.cos(step / 2)
            v = good.value[inside].values
            row = got.iloc[i]
            assert row[f"pixels_count_{size}m"] == len(v)
            if len(v):
                expected = (v.mean(), v.sum(), v.max(), v.min(), v.std(), np.median(v))
                found = [row[f"{s}_{size}m"] for s in raster.ALL_STATS[:6]]
                assert np.allclose(found, expected, rtol=1e-12, atol=1e-7)


def test_equally_close_years_take_the_earlier(spark):
    bills = spark.createDataFrame([(1, 2015), (2, 2030), (3, None)], "nis_rad long, year int")
    pixels = spark.createDataFrame([(2016,), (2014,)], "year int")
    got = raster.nearest_year(bills, pixels).orderBy("nis_rad").collect()
    assert [r.raster_year for r in got] == [2014, 2016, None]


def test_pixels_at_the_edge_and_unknown_values(spark):
    left, _, bottom, top = 33.91261, 41.91261, -4.670972, 5.470695
    points = spark.createDataFrame(
        [(1, top - 1216.5 * 0.008340186677631579, left + 960.5 * 0.008333), (2, top - 0.001, left + 0.001), (3, None, 1.0)],
        "NIS_RAD long, LAT double, LON double",
    )
    cells = spark.createDataFrame(
        [(1215, 959, 100.0), (0, 0, 7.0)], "Y int, X int, pixel_value double"
    )
    got = raster.classify_pixels(points, cells).withColumn(
        "binary", scalars.binary_rural_urban(F.col("classification"))
    )
    rows = {r.NIS_RAD: (r.X, r.Y, r.classification, r.binary) for r in got.collect()}
    assert rows == {1: (959, 1215, "Rural", "Rural"), 2: (0, 0, None, "Urban")}


def test_growing_sides_of_small_files_are_not_broadcast(spark, tmp_path):
    """Only the tree's upper levels are; sizes of files say nothing of copies that explode makes."""
    roads_at, points_at = str(tmp_path / "roads"), str(tmp_path / "points")
    spark.createDataFrame([("A", 36.0, -1.0, 36.01, -1.0)], "ROADCLASS string, x1 double, y1 double, x2 double, y2 double").write.parquet(roads_at)
    spark.createDataFrame([(1, -1.001, 36.005)], "NIS_RAD long, LAT double, LON double").write.parquet(points_at)
    points, segments = spark.read.parquet(points_at), spark.read.parquet(roads_at)

    def broadcasts(df):
        return df._jdf.queryExecution().sparkPlan().toString().count("BroadcastHashJoin")

    nearest = roads.nearest_segment_distance(points, segments)
    lengths = roads.segment_length_in_buffer(points, segments)
    assert broadcasts(nearest) <= pyramid.TREE_BROADCAST + 1 and broadcasts(lengths) == 0
    assert broadcasts(proximity.points_in_buffer(points, points, 500)) == 0
    assert nearest.first()["distance_to_road"] == pytest.approx(0.001)
    assert lengths.first()["total_road_length"] == pytest.approx(0.01)
