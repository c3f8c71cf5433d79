"""Distance to the nearest road and road length in a buffer, over road segments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from gridpanel import constants as C
from gridpanel.functions import spatial
from gridpanel.functions.clipping import lengths_in_cell, nearest_in_cell
from gridpanel.operators import pyramid as pyr
from gridpanel.session import written

ENDS = ("x1", "y1", "x2", "y2")


def _distinct_segments(segments: DataFrame, columns: Sequence[str] = ()) -> DataFrame:
    """Segments once each, whichever way they run, with their boxes."""
    usable = segments.dropna(subset=list(ENDS))
    swap = F.struct("x1", "y1") > F.struct("x2", "y2")
    flipped = usable.select(
        *columns,
        F.when(swap, F.col("x2")).otherwise(F.col("x1")).alias("x1"),
        F.when(swap, F.col("y2")).otherwise(F.col("y1")).alias("y1"),
        F.when(swap, F.col("x1")).otherwise(F.col("x2")).alias("x2"),
        F.when(swap, F.col("y1")).otherwise(F.col("y2")).alias("y2"),
    )
    return _boxed(flipped.distinct())


def _boxed(segments: DataFrame) -> DataFrame:
    return segments.withColumns(
        {
            "_xlo": F.least("x1", "x2"),
            "_ylo": F.least("y1", "y2"),
            "_xhi": F.greatest("x1", "x2"),
            "_yhi": F.greatest("y1", "y2"),
        }
    )


# Levels below the start level, whose cells are at least as wide as the radius, where points meet roads.
CELLS_BELOW = 1
# Directions (radians) and offsets (degrees) of lines that agree so far are those of one line.
DIRECTION_DIGITS, OFFSET_DIGITS = 9, 8


def merged_lines(segments: DataFrame, pitch: float, columns: Sequence[str] = ()) -> DataFrame:
    """The union of the segments of each group of `columns`: stretches that several of them cover are there once.

    Segments are cut where the distance along their line passes a multiple of `pitch`. The pieces of one line and
    stretch are intervals; in order of their beginnings, one that begins behind all ends so far opens a new
    interval. A stretch holds a bounded length, so no task holds a whole line, and no piece is
    longer than `pitch`. Segments without length are left out.
    """
    lined = _distinct_segments(segments, columns).filter("x1 != x2 or y1 != y2")
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    # Ends are in order of x, then y, so a line has one direction.
    lined = lined.withColumn("_l", F.hypot(dx, dy)).withColumns({"_ux": dx / F.col("_l"), "_uy": dy / F.col("_l")})
    along = lambda x, y: F.col("_ux") * F.col(x) + F.col("_uy") * F.col(y)
    lined = lined.withColumns(
        {
            "_turn": F.round(F.atan2("_uy", "_ux"), DIRECTION_DIGITS),
            "_off": F.round(F.col("_ux") * F.col("y1") - F.col("_uy") * F.col("x1"), OFFSET_DIGITS),
            "_t1": along("x1", "y1"),
            "_t2": along("x2", "y2"),
        }
    )
    cut = lined.withColumn("_k", F.explode(F.sequence(F.floor(F.col("_t1") / pitch), F.floor(F.col("_t2") / pitch))))

    def end(t: Column, own: Column, x: str, y: str) -> Column:
        """A piece's end: the segment's own, or the point where it is cut."""
        gone = t - F.col("_t1")
        return F.when(own, F.struct(F.col(x).alias("x"), F.col(y).alias("y"))).otherwise(
            F.struct((F.col("x1") + gone * F.col("_ux")).alias("x"), (F.col("y1") + gone * F.col("_uy")).alias("y"))
        )

    low, high = F.col("_k") * pitch, (F.col("_k") + 1) * pitch
    line = [*columns, "_turn", "_off", "_k"]
    pieces = cut.select(
        *line,
        F.greatest("_t1", low).alias("_from"),
        F.least("_t2", high).alias("_to"),
        end(low, F.col("_t1") >= low, "x1", "y1").alias("_a"),
        end(high, F.col("_t2") <= high, "x2", "y2").alias("_b"),
    )
    order = Window.partitionBy(*line).orderBy("_from", "_to")
    before = F.max("_to").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = F.when(before.isNull() | (F.col("_from") > before), 1).otherwise(0)
    numbered = pieces.withColumn("_new", opened).withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = numbered.groupBy(*line, "_island").agg(F.min_by("_a", "_from").alias("_a"), F.max_by("_b", "_to").alias("_b"))
    ends = whole.select(
        *columns,
        F.col("_a.x").alias("x1"),
        F.col("_a.y").alias("y1"),
        F.col("_b.x").alias("x2"),
        F.col("_b.y").alias("y2"),
    )
    return _boxed(ends)


def _places(points: DataFrame, key: str, xy: tuple[str, str]) -> tuple[DataFrame, DataFrame]:
    at = points.select(key, F.col(xy[0]).alias("_x"), F.col(xy[1]).alias("_y"))
    return at, pyr.spread(at.dropna(subset=["_x", "_y"]).select("_x", "_y").distinct())


def nearest_segment_distance(
    points: DataFrame,
    segments: DataFrame,
    key: str = "NIS_RAD",
    xy: tuple[str, str] = ("LON", "LAT"),
    out: str = "distance_to_road",
    leaf_items: int = pyr.LEAF_ITEMS,
) -> DataFrame:
    """Distance in degrees from every point to the nearest segment of any class.

    A point meets the segments that pass through its own cell. Where none does, or the nearest of them is further than the
    cell's rim, the point visits the other cells within reach, which a tree of all cells with segments bounds; no pair
    of a point and a segment is shuffled. The points with what they found in their own cells, and the boxes of cells, are written once
    when this is called. Points without coordinates, or no segments at all: NULL.
    """
    passed = pyr.passed_cells(_distinct_segments(segments), ENDS)
    pieces = passed.select("_cell", *ENDS).groupBy("_cell")
    at, centers = _places(points, key, xy)
    schema = T.StructType([*centers.schema.fields, T.StructField("_near", T.DoubleType())])
    run, home = nearest_in_cell(ENDS, to_arrow_schema(schema)), pyr.passed_cell(F.col("_x"), F.col("_y"))
    own = written(centers.withColumn("_cell", home).groupBy("_cell").cogroup(pieces).applyInArrow(run, schema))
    left = own.filter(F.col("_near").isNull() | (F.col("_near") > pyr.rim_distance(F.col("_x"), F.col("_y"))))
    boxes = [f(b).alias(b) for f, b in zip((F.min, F.min, F.max, F.max), pyr.BOX)]
    tree = pyr.build_tree(written(passed.groupBy(F.col("_cell").alias("_at")).agg(*boxes)), leaf_items)
    bound = pyr.tree_bound(left, tree).join(pyr.unbroadcast(left), ["_x", "_y"])
    bound = bound.select("_x", "_y", F.least("_r", F.col("_near") * pyr.SLACK).alias("_r"))
    within = pyr.tree_leaves(bound, tree).join(pyr.unbroadcast(pyr.tree_items(tree, ["_at", *pyr.BOX])), "_cell")
    within = within.filter(spatial.box_min_sq("_x", "_y", *pyr.BOX) <= F.col("_r") * F.col("_r") * pyr.SLACK)
    others = within.filter(F.col("_at") != home).select(F.col("_at").alias("_cell"), "_x", "_y")
    met = others.groupBy("_cell").cogroup(pieces).applyInArrow(run, schema)
    nearest = own.unionByName(met).groupBy("_x", "_y").agg(F.min("_near").alias(out))
    return at.join(pyr.unbroadcast(nearest), ["_x", "_y"], "left").select(key, out)


def segment_length_in_buffer(
    points: DataFrame,
    segments: DataFrame,
    meters: float = C.ROAD_BUFFER_METERS,
    classes: Sequence[str] = ("A", "B"),
    key: str = "NIS_RAD",
    xy: tuple[str, str] = ("LON", "LAT"),
    class_col: str = "ROADCLASS",
    levels: int = pyr.RADIUS_LEVELS,
) -> DataFrame:
    """Length in degrees of each class within the buffer, and the classes' total.

    0 where no road is near, NULL for points without coordinates. What several roads of a class
    cover counts once. Roads are cut to pieces no longer than the radius, so one long road widens no search. Points meet cells
    some way below the radius, and `clipping.buffer_lengths` adds up the roads of a cell for all points that reach it.
    """
    radius = spatial.radius_degrees(meters)
    wanted = segments.filter(F.col(class_col).isin(*classes))
    lined = merged_lines(wanted, radius, [class_col])
    grid = pyr.radius_grid(lined, radius, levels, radius * (1 + 1e-9) / 2)
    at, centers = _places(points, key, xy)
    level = min(pyr.start_level(grid, radius) + CELLS_BELOW, grid.depth)
    front = pyr.search(centers, grid, [], radius, deepest=level).select("_cell", "_x", "_y")
    pieces = grid.items.select(grid.cell(level).alias("_cell"), class_col, *ENDS)
    parts = T.StructType([*front.schema.fields[1:], pieces.schema[class_col], T.StructField("_part", T.DoubleType())])
    run = lengths_in_cell(radius, class_col, ENDS, to_arrow_schema(parts))
    hits = front.groupBy("_cell").cogroup(pieces.groupBy("_cell")).applyInArrow(run, parts)
    names = {c: f"road_class_{c}_length" for c in classes}
    sums = hits.groupBy("_x", "_y").agg(
        *[F.sum(F.when(F.col(class_col) == c, F.col("_part"))).alias(n) for c, n in names.items()]
    )
    joined = at.join(pyr.unbroadcast(sums), ["_x", "_y"], "left")
    located = F.col("_x").isNotNull() & F.col("_y").isNotNull()
    filled = joined.select(
        key, *[F.when(located, F.coalesce(F.col(n), F.lit(0.0))).alias(n) for n in names.values()]
    )
    total = sum((F.col(n) for n in names.values()), F.lit(0.0))
    return filled.withColumn("total_road_length", total)


def road_features(
    points: DataFrame, segments: DataFrame, kind: str = "both", key: str = "NIS_RAD", **kwargs
) -> DataFrame:
    """Distances, lengths or both, one row per point."""
    if kind not in ("distances", "lengths", "both"):
        raise ValueError(f"unknown road feature: {kind}")
    if kind == "distances":
        return nearest_segment_distance(points, segments, key)
    lengths = segment_length_in_buffer(points, segments, key=key, **kwargs)
    if kind == "lengths":
        return lengths
    return nearest_segment_distance(points, segments, key).join(pyr.unbroadcast(lengths), key, "left")
