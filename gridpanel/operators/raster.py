"""Raster statistics around points, nearest raster year, and pixel lookup."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridpanel import constants as C
from gridpanel.functions import dates, scalars, spatial
from gridpanel.operators.pyramid import unbroadcast

ALL_STATS = ("mean", "sum", "max", "min", "std", "median", "pixels_count", "pixels_nonzero")


def _tiles(at: str, reach: float, side: float) -> Column:
    return F.sequence(
        F.floor((F.col(at) - reach) / side), F.floor((F.col(at) + reach) / side)
    )


def pixel_rows(pixels: DataFrame, side: float, keys: Sequence[str] = ()) -> DataFrame:
    """One row for each pixel row of a tile: `keys`, `_tx`, `_ty`, `lat_c`, `_base` and `_cells`.

    Cells lie in order of longitude, each with the sum (`s`) and the squares' sum (`q`) of all values up to it, less
    the first value of the row, `_base`, so that they stay small, and how many of them are positive (`p`).
    Pixels meet `_cells` once; whatever lies between two places of a row is a difference.
    """
    tiled = pixels.select(
        *keys,
        "lon_c",
        "lat_c",
        F.col("value").cast("double").alias("value"),
        F.floor(F.col("lon_c") / side).alias("_tx"),
        F.floor(F.col("lat_c") / side).alias("_ty"),
    )
    line = [*keys, "_tx", "_ty", "lat_c"]
    order = Window.partitionBy(*line).orderBy("lon_c", "value")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    tiled = tiled.withColumns({"_i": F.row_number().over(order), "_base": F.first("value").over(upto)})
    off = F.col("value") - F.col("_base")
    cells = tiled.withColumns(
        {
            "s": F.sum(off).over(upto),
            "q": F.sum(off * off).over(upto),
            "p": F.sum((F.col("value") > 0).cast("int")).over(upto),
        }
    )
    cell = F.struct(F.col("lon_c").alias("x"), F.col("_i").alias("i"), F.col("value").alias("v"), "s", "q", "p")
    return cells.groupBy(*line).agg(
        F.any_value("_base").alias("_base"), F.array_sort(F.collect_list(cell)).alias("_cells")
    )


def _first_place(cells: Column, holds) -> Column:
    """The first place, from 1, whose cell passes a test that all cells behind it pass, too; one behind the last if none does."""
    n = F.size(cells)
    halvings = F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.log2(n + 1)).cast("int")))

    def halve(at: Column, _: Column) -> Column:
        middle = F.shiftright(at["lo"] + at["hi"], 1)
        passed = holds(F.get(cells, middle - 1))
        return (
            F.when(at["lo"] >= at["hi"], at)
            .when(passed, F.struct(at["lo"].alias("lo"), middle.alias("hi")))
            .otherwise(F.struct((middle + 1).alias("lo"), at["hi"].alias("hi")))
        )

    return F.aggregate(halvings, F.struct(F.lit(1).alias("lo"), (n + 1).alias("hi")), halve, lambda at: at["lo"])


def _piece(reach: float) -> Column:
    """What one pixel row adds to a buffer: the cells between the two places where the polygon's rim cuts it."""
    cells, dy = F.col("_cells"), F.col("lat_c") - F.col("_y")
    inside = lambda c: spatial.in_buffer(c["x"] - F.col("_x"), dy, reach)
    first = _first_place(cells, lambda c: (c["x"] > F.col("_x")) | inside(c))
    behind = _first_place(cells, lambda c: (c["x"] > F.col("_x")) & ~inside(c))
    return F.struct(first.alias("first"), (behind - first).alias("n"))


def _sums(piece: str, stats: Sequence[str]) -> Column:
    """Count, mean, squares around it and positive values of a piece; its values if they are asked for."""
    first, n = F.col(piece)["first"], F.col(piece)["n"]
    last, before = F.get("_cells", first + n - 2), F.get("_cells", F.when(first > 1, first - 2))
    least = lambda name: last[name] - F.coalesce(before[name], F.lit(0))
    off = least("s")
    fields = [
        n.alias("n"),
        (F.col("_base") + off / n).alias("mean"),
        (F.col("_base") * n + off).alias("sum"),
        F.greatest(F.lit(0.0), least("q") - off * off / n).alias("squares"),
        least("p").alias("p"),
    ]
    values = F.transform(F.slice("_cells", first, n), lambda c: c["v"])
    own = {"max": F.array_max(values), "min": F.array_min(values), "median": values}
    fields += [own[name].alias(name) for name in own if name in stats]
    return F.when(n > 0, F.struct(*fields))


def _merged(rows: Column) -> Column:
    """Count, mean and squares of several pieces together, without large numbers that cancel."""

    def add(all_: Column, row: Column) -> Column:
        n, gap = all_["n"] + row["n"], row["mean"] - all_["mean"]
        return F.struct(
            n.alias("n"),
            (all_["mean"] + gap * row["n"] / n).alias("mean"),
            (all_["squares"] + row["squares"] + gap * gap * all_["n"] * row["n"] / n).alias("squares"),
        )

    start = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("squares"))
    return F.aggregate(rows, start, add, lambda a: F.sqrt(a["squares"] / F.when(a["n"] > 0, a["n"])))


def _stat(name: str, rows: str) -> Column:
    """One statistic of the pieces of a buffer."""
    piece = F.col(rows)
    count = F.sum(piece["n"])
    if name == "median":
        # A buffer holds a bounded number of pixels, so its values fit in memory.
        values = F.array_sort(F.flatten(F.collect_list(piece["median"])))
        half = (F.size(values) - 1) / 2
        pick = lambda at: F.get(values, at.cast("int"))
        return (pick(F.floor(half)) + pick(F.ceil(half))) / 2
    if name in ("max", "min"):
        return (F.max if name == "max" else F.min)(piece[name])
    return {
        "mean": F.sum(piece["sum"]) / count,
        "sum": F.sum(piece["sum"]),
        # One piece for each pixel row of the buffer.
        "std": _merged(F.collect_list(piece)),
        "pixels_count": count,
        "pixels_nonzero": F.sum(piece["p"]),
    }[name]


def zonal_stats(
    points: DataFrame,
    pixels: DataFrame,
    meters: float | Sequence[float] = C.BUFFER_METERS,
    stats: Sequence[str] = ALL_STATS,
    nodata: float = C.LIGHTS_NODATA,
    max_valid: float | None = None,
    prefix: str = "",
    year: str | None = None,
    key: str = "NIS_RAD",
    xy: tuple[str, str] = ("LON", "LAT"),
) -> DataFrame:
    """Statistics of the pixels whose centre lies in the buffer, one row per point.

    Finite pixel values from `nodata` up to `max_valid` count. With several buffer sizes the
    columns are named `{prefix}{stat}_{size}m` and the rasters are joined only once, at
    the largest size. With `year`, points and pixels meet on that column as well.

    Points meet pixel rows, not pixels: the buffer polygon is convex, so it covers one
    interval of each row, found by halving, and its sums are differences of two cells. Rows
    are cut at tiles as wide as the largest buffer, so a point is copied to at most four.
    """
    sizes = [meters] if isinstance(meters, (int, float)) else sorted(meters)
    many = not isinstance(meters, (int, float))
    on_year = [year] if year else []
    reach = spatial.radius_degrees(max(sizes))
    side = 2 * reach
    at = points.select(
        key, *on_year, F.col(xy[0]).alias("_x"), F.col(xy[1]).alias("_y")
    )
    places = at.dropna(subset=["_x", "_y"]).select("_x", "_y", *on_year).distinct()
    slack = reach * (1 + 1e-9)
    tiled = places.select(
        "*", F.explode(_tiles("_x", slack, side)).alias("_tx"), _tiles("_y", slack, side).alias("_t")
    ).select("_x", "_y", *on_year, "_tx", F.explode("_t").alias("_ty"))
    value = F.col("value")
    valid = (value >= nodata) & (value < float("inf")) & (value > float("-inf"))
    if max_valid is not None:
        valid = valid & (value <= max_valid)
    rows = pixel_rows(pixels.filter(valid), side, on_year)
    met = tiled.join(unbroadcast(rows), [*on_year, "_tx", "_ty"]).filter(F.abs(F.col("lat_c") - F.col("_y")) <= slack)
    met = met.withColumns({f"_p{i}": _piece(spatial.radius_degrees(size)) for i, size in enumerate(sizes)})
    # The largest buffer holds the others.
    met = met.filter(F.col(f"_p{len(sizes) - 1}.n") > 0)
    met = met.select("_x", "_y", *on_year, *[_sums(f"_p{i}", stats).alias(f"_s{i}") for i in range(len(sizes))])
    columns = {
        f"{prefix}{name}_{size}m" if many else f"{prefix}{name}": _stat(name, f"_s{i}")
        for i, size in enumerate(sizes)
        for name in stats
    }
    summed = met.groupBy("_x", "_y", *on_year).agg(*[c.alias(n) for n, c in columns.items()])
    joined = at.join(unbroadcast(summed), ["_x", "_y", *on_year], "left")
    located = F.col("_x").isNotNull() & F.col("_y").isNotNull()
    return joined.select(
        key,
        *on_year,
        *[F.when(located, F.coalesce(F.col(n), F.lit(0))).alias(n) for n in columns],
    )


def nearest_year(
    bills: DataFrame,
    pixels: DataFrame,
    year: Column | None = None,
    out: str = "raster_year",
    years: Sequence[int] | None = None,
) -> DataFrame:
    """Bills with the raster year closest to their own; of two equally close, the earlier."""
    target = dates.bill_year(bills) if year is None else year
    if years is not None:
        known = F.array(*[F.lit(int(y)) for y in sorted(years)])
    else:
        # Calendar years: a short list whatever the size of the rasters.
        known = pixels.agg(F.sort_array(F.collect_set("year")).alias("y")).scalar()
    rows = bills.withColumns({"_target": target, "_years": known})
    ranked = F.transform(
        "_years", lambda y: F.struct(F.abs(y - F.col("_target")).alias("gap"), y.alias("year"))
    )
    best = F.when(F.col("_target").isNotNull(), F.array_min(ranked)["year"])
    return rows.withColumn(out, best).drop("_target", "_years")


def yearly_zonal_stats(
    bills: DataFrame,
    locations: DataFrame,
    pixels: DataFrame,
    stats: dict[str, str],
    meters: float = C.BUFFER_METERS,
    nodata: float = 0.0,
    allow_date: bool = True,
) -> DataFrame:
    """Statistics per (nis_rad, year) of the bills, from the raster year closest to each.

    `stats` maps output columns to statistics. Pixels are read once per customer and
    raster year, never per bill.
    """
    dated = bills.select("nis_rad", dates.bill_year(bills, allow_date).alias("year")).distinct()
    asked = nearest_year(dated, pixels, F.col("year"))
    placed = asked.join(
        locations.select(F.col("NIS_RAD").alias("nis_rad"), "LAT", "LON"), "nis_rad"
    )
    points = placed.select("nis_rad", "LAT", "LON", "raster_year").distinct()
    rasters = pixels.withColumnRenamed("year", "raster_year")
    names = list(dict.fromkeys(stats.values()))
    zonal = zonal_stats(
        points, rasters, meters, names, nodata=nodata, year="raster_year", key="nis_rad"
    )
    return asked.join(zonal, ["nis_rad", "raster_year"]).select(
        "nis_rad", "year", *[F.col(stat).alias(out) for out, stat in stats.items()]
    )


def population_features(
    bills: DataFrame, locations: DataFrame, pixels: DataFrame, meters: float = C.BUFFER_METERS
) -> DataFrame:
    """Population in the buffer; negative pixels count as 0, which is to leave them out."""
    return yearly_zonal_stats(
        bills, locations, pixels, {"population": "sum"}, meters, allow_date=False
    )


def lights_features(
    bills: DataFrame, locations: DataFrame, pixels: DataFrame, meters: float = C.BUFFER_METERS
) -> DataFrame:
    """Night-light statistics in the buffer over the pixels that are not negative."""
    stats = {
        "lights_mean": "mean",
        "lights_sum": "sum",
        "lights_max": "max",
        "lights_std": "std",
        "lights_pixels": "pixels_count",
    }
    return yearly_zonal_stats(bills, locations, pixels, stats, meters)


def classify_pixels(points: DataFrame, raster: DataFrame) -> DataFrame:
    """Located points with pixel, raster value and settlement class; NULL off the raster."""
    x, y = spatial.pixel_coordinates("LAT", "LON")
    located = points.dropna(subset=["LAT", "LON"]).withColumns({"X": x, "Y": y})
    joined = located.join(raster.select("Y", "X", "pixel_value"), ["Y", "X"], "left")
    return joined.select(
        *points.columns,
        "X",
        "Y",
        "pixel_value",
        scalars.pixel_class(F.col("pixel_value")).alias("classification"),
    )
