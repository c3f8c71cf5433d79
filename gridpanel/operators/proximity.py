"""Points around points: counts in a radius, points in a buffer, electrified structures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridpanel import constants as C
from gridpanel.functions import dates, spatial
from gridpanel.operators import pyramid as pyr


def _boxed(points: DataFrame, x: str, y: str, columns: Sequence[str]) -> DataFrame:
    return points.select(
        *columns,
        F.col(x).alias("_xlo"),
        F.col(y).alias("_ylo"),
        F.col(x).alias("_xhi"),
        F.col(y).alias("_yhi"),
    )


def _weights_around(
    centers: DataFrame,
    points: DataFrame,
    meters: float,
    shape: str,
    by: Sequence[str],
    weight: str,
    levels: int,
) -> DataFrame:
    """Sum of `weight` per center (`_x`, `_y`) and group over the points within reach.

    `centers` are distinct places; `points` has columns `_px`, `_py`, the groups and
    the weight, with equal places already added up.
    """
    radius = spatial.radius_degrees(meters)
    grid = pyr.radius_grid(_boxed(points, "_px", "_py", [*by, weight]), radius, levels)
    found = pyr.search_items(pyr.spread(centers), grid, [], radius, spatial.INNER_SHARE[shape], by, [weight], weight)
    inside = spatial.INSIDE_TESTS[shape](
        F.col("_item._xlo") - F.col("_x"), F.col("_item._ylo") - F.col("_y"), F.col("_r")
    )
    hits = found.filter(F.col("_whole") | inside)
    return hits.groupBy("_x", "_y", *by).agg(
        F.sum(F.when(F.col("_whole"), F.col("_sum")).otherwise(F.col(f"_item.{weight}"))).alias(weight)
    )


def count_in_radius(
    left: DataFrame,
    right: DataFrame,
    meters: float = C.BUFFER_METERS,
    by: str | None = None,
    shape: str = "circle",
    key: str = "NIS_RAD",
    left_xy: tuple[str, str] = ("LON", "LAT"),
    right_xy: tuple[str, str] = ("Lon", "Lat"),
    pivot: bool = False,
    values: Sequence[str] | None = None,
    levels: int = pyr.RADIUS_LEVELS,
) -> DataFrame:
    """Points of `right` around each row of `left`, in total or per value of `by`.

    Long form: (key, by, n) for groups that occur around a row; with `pivot` one column
    per group, 0 where none is near. Without `by`: (key, n) with 0. The columns are `values`, or
    else all groups that `right` has: name them, or use the long form, where groups are many.
    """
    groups = [by] if by else []
    places = (
        right.select(F.col(right_xy[0]).alias("_px"), F.col(right_xy[1]).alias("_py"), *groups)
        .dropna(subset=["_px", "_py", *groups])
        .groupBy("_px", "_py", *groups)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    at = left.select(key, F.col(left_xy[0]).alias("_x"), F.col(left_xy[1]).alias("_y"))
    centers = at.dropna(subset=["_x", "_y"]).select("_x", "_y").distinct()
    counts = _weights_around(centers, places, meters, shape, groups, "n", levels)
    if by and not pivot:
        return at.join(pyr.unbroadcast(counts), ["_x", "_y"]).select(key, by, "n")
    if by:
        if values is None:
            # The groups of the points, not of the hits; each becomes a column.
            kinds = right.filter(F.col(by).isNotNull()).select(by).distinct().orderBy(by)
            values = [row[0] for row in kinds.collect()]
        wide = counts.groupBy("_x", "_y").pivot(by, list(values)).agg(F.sum("n"))
        names = [c for c in wide.columns if c not in ("_x", "_y")]
    else:
        wide, names = counts, ["n"]
    joined = at.join(pyr.unbroadcast(wide), ["_x", "_y"], "left")
    return joined.select(key, *[F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias(c) for c in names])


def points_in_buffer(
    centers: DataFrame,
    points: DataFrame,
    meters: float = C.BUFFER_METERS,
    shape: str = "polygon",
    key: str = "NIS_RAD",
    left_xy: tuple[str, str] = ("LON", "LAT"),
    right_xy: tuple[str, str] = ("LON", "LAT"),
    columns: Sequence[str] | None = None,
    levels: int = pyr.RADIUS_LEVELS,
) -> DataFrame:
    """One row per center and point inside its buffer, with the point's columns.

    Every such pair is a row: that is what this operator is for. Counts don't form pairs.
    """
    radius = spatial.radius_degrees(meters)
    columns = list(columns or points.columns)
    clashing = {c: f"point_{c}" for c in columns if c.lower() == key.lower()}
    side = points.dropna(subset=list(right_xy)).select(
        *[F.col(c).alias(clashing.get(c, c)) for c in columns],
        F.col(right_xy[0]).alias("_px"),
        F.col(right_xy[1]).alias("_py"),
    )
    names = [clashing.get(c, c) for c in columns]
    grid = pyr.radius_grid(_boxed(side, "_px", "_py", names), radius, levels)
    at = centers.dropna(subset=list(left_xy)).select(
        key, F.col(left_xy[0]).alias("_x"), F.col(left_xy[1]).alias("_y")
    )
    found = pyr.search_items(pyr.spread(at), grid, [key], radius, spatial.INNER_SHARE[shape], [], names)
    inside = spatial.INSIDE_TESTS[shape](
        F.col("_item._xlo") - F.col("_x"), F.col("_item._ylo") - F.col("_y"), F.col("_r")
    )
    return found.filter(F.col("_whole") | inside).select(key, *[F.col(f"_item.`{n}`").alias(n) for n in names])


def match_transformers(customers: DataFrame, transformers: DataFrame) -> DataFrame:
    """Customers standing on a transformer's exact coordinates, once per transformer."""
    sites = transformers.groupBy("LAT", "LON").agg(F.count(F.lit(1)).alias("_tx"))
    matched = customers.join(pyr.unbroadcast(sites), ["LAT", "LON"])
    return matched.withColumn("_tx", F.explode(F.sequence(F.lit(1), F.col("_tx")))).drop("_tx")


def _structure_weights(
    customers: DataFrame, transformers: DataFrame, by: Sequence[str], first: str | None
) -> tuple[DataFrame, DataFrame]:
    """Matches with transformers, and customers that are no transformer, per place."""
    sites = transformers.groupBy("LAT", "LON").agg(F.count(F.lit(1)).alias("n"))
    matches = (
        customers.groupBy("LAT", "LON", *by)
        .agg(F.count(F.lit(1)).alias("_c"))
        .join(pyr.unbroadcast(sites), ["LAT", "LON"])
        .select("LAT", "LON", *by, (F.col("_c") * F.col("n")).alias("n"))
    )
    labels = transformers.select(F.col("tx_id").alias("_tx"))
    others = customers.join(pyr.unbroadcast(labels), F.col("NIS_RAD") == F.col("_tx"), "left_anti")
    if first:
        others = others.groupBy("LAT", "LON").agg(F.min(first).alias(first))
    else:
        others = others.groupBy("LAT", "LON").agg(F.lit(0))
    return matches, others


def count_structures(customers: DataFrame, transformers: DataFrame) -> DataFrame:
    """Electrified structures of a set of customers: transformer matches plus distinct
    places of the customers that are no transformer themselves."""
    matches, others = _structure_weights(customers, transformers, [], None)
    parts = matches.select("n").unionByName(others.select(F.lit(1).cast("long").alias("n")))
    return parts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("electrified_structures"))


def valid_customers(customers: DataFrame) -> DataFrame:
    """Customers with coordinates and a readable installation date, as a month."""
    installed = dates.month(dates.parse_day_first(customers, "installation"))
    return customers.withColumn("installation", installed).dropna(
        subset=["LAT", "LON", "installation"]
    )


def electrified_structures(
    bills: DataFrame,
    customers: DataFrame,
    transformers: DataFrame,
    meters: float = C.BUFFER_METERS,
    order: Sequence[str] = ("LAT", "LON"),
    levels: int = pyr.RADIUS_LEVELS,
) -> DataFrame:
    """Structures electrified by the bill month around the customer of each bill.

    One row per (nis_rad, period). Months enter as additions: a place counts from the
    month it first has a structure, and the months are summed up per customer, so no
    pair of bill and structure is formed.
    """
    valid = valid_customers(customers)
    matches, others = _structure_weights(valid, transformers, ["installation"], "installation")
    additions = (
        matches.unionByName(others.withColumn("n", F.lit(1).cast("long")))
        .groupBy(F.col("LON").alias("_px"), F.col("LAT").alias("_py"), "installation")
        .agg(F.sum("n").alias("n"))
    )
    # The customer's own place: of the rows with that id and coordinates, the first in `order`.
    places = customers.dropna(subset=["LAT", "LON"]).groupBy(F.col("NIS_RAD").alias("nis_rad")).agg(
        F.min(F.struct(*order, F.col("LAT").alias("_y"), F.col("LON").alias("_x"))).alias("_p")
    )
    asked = bills.select("nis_rad", dates.month(dates.parse_day_first(bills, "period")).alias("period"))
    asked = asked.distinct()
    billed = asked.select("nis_rad").distinct()
    at = places.join(billed, "nis_rad", "left_semi").select("nis_rad", "_p._x", "_p._y")
    centers = at.select("_x", "_y").distinct()
    around = _weights_around(
        centers, additions, meters, "polygon", ["installation"], "n", levels
    )
    steps = at.join(pyr.unbroadcast(around), ["_x", "_y"]).select(
        "nis_rad", F.col("installation").alias("period"), "n", F.lit(False).alias("_asked")
    )
    zeros = asked.select("nis_rad", "period", F.lit(0).alias("n"), F.lit(True).alias("_asked"))
    # At most one row per customer and month, so a customer's rows are bounded by the calendar.
    monthly = (
        steps.unionByName(zeros)
        .groupBy("nis_rad", "period")
        .agg(F.sum("n").alias("n"), F.max("_asked").alias("_asked"))
    )
    running = Window.partitionBy("nis_rad").orderBy("period")
    return (
        monthly.withColumn("electrified_structures", F.sum("n").over(running))
        .filter("_asked")
        .select("nis_rad", "period", "electrified_structures")
    )
