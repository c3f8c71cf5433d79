"""Planar geometry in degrees, as Column expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridpanel import constants as C


def radius_degrees(meters: float) -> float:
    """Buffer radius in degrees: the wider of the latitude and longitude conversions."""
    return max(meters / C.METERS_PER_DEGREE_LAT, meters / C.METERS_PER_DEGREE_LON)


def _col(value) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def distance(x1, y1, x2, y2) -> Column:
    dx, dy = _col(x1) - _col(x2), _col(y1) - _col(y2)
    return F.sqrt(dx * dx + dy * dy)


def in_circle(dx: Column, dy: Column, radius) -> Column:
    """Inclusive distance test."""
    return F.sqrt(dx * dx + dy * dy) <= radius


def in_buffer(dx: Column, dy: Column, radius) -> Column:
    """Strictly inside the regular 64-gon inscribed in the circle, first vertex at angle 0.

    The polygon's rim at angle ``th`` lies at ``r * cos(s/2) / cos(th mod s - s/2)``.
    """
    step = 2 * math.pi / C.BUFFER_SIDES
    offset = F.pmod(F.atan2(dy, dx), F.lit(step)) - step / 2
    return F.hypot(dx, dy) * F.cos(offset) < radius * math.cos(step / 2)


INSIDE_TESTS = {"circle": in_circle, "polygon": in_buffer}

# Share of the radius within which a point is inside for certain, by shape.
INNER_SHARE = {"circle": 1.0, "polygon": math.cos(math.pi / C.BUFFER_SIDES)}


def box_min_sq(x, y, xlo, ylo, xhi, yhi) -> Column:
    """Squared distance from a point to the nearest point of a box."""
    x, y = _col(x), _col(y)
    zero = F.lit(0.0)
    dx = F.greatest(_col(xlo) - x, zero, x - _col(xhi))
    dy = F.greatest(_col(ylo) - y, zero, y - _col(yhi))
    return dx * dx + dy * dy


def box_max_sq(x, y, xlo, ylo, xhi, yhi) -> Column:
    """Squared distance from a point to the farthest corner of a box."""
    x, y = _col(x), _col(y)
    dx = F.greatest(x - _col(xlo), _col(xhi) - x)
    dy = F.greatest(y - _col(ylo), _col(yhi) - y)
    return dx * dx + dy * dy


def segment_length(x1, y1, x2, y2) -> Column:
    return distance(x1, y1, x2, y2)


def segment_distance(px, py, x1, y1, x2, y2) -> Column:
    """Distance from a point to a segment; a segment of length 0 is a point."""
    px, py, x1, y1, x2, y2 = map(_col, (px, py, x1, y1, x2, y2))
    dx, dy = x2 - x1, y2 - y1
    len2 = dx * dx + dy * dy
    along = F.when(len2 > 0, ((px - x1) * dx + (py - y1) * dy) / len2).otherwise(0.0)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))
    ex, ey = px - (x1 + t * dx), py - (y1 + t * dy)
    return F.sqrt(ex * ex + ey * ey)


def _share_by_sides() -> Column:
    """Share of a segment inside the polygon, bounded by each side in turn."""
    step = 2 * math.pi / C.BUFFER_SIDES
    sides = F.array(
        *[
            F.struct(
                F.lit(math.cos((k + 0.5) * step)).alias("nx"),
                F.lit(math.sin((k + 0.5) * step)).alias("ny"),
            )
            for k in range(C.BUFFER_SIDES)
        ]
    )

    def narrow(acc: Column, side: Column) -> Column:
        speed = side["nx"] * F.col("_dx") + side["ny"] * F.col("_dy")
        room = F.col("_h") - (side["nx"] * F.col("_ax") + side["ny"] * F.col("_ay"))
        hit = room / F.when(speed != 0, speed)
        return F.struct(
            F.when(speed < 0, F.greatest(acc["lo"], hit))
            .when((speed == 0) & (room < 0), F.lit(2.0))
            .otherwise(acc["lo"])
            .alias("lo"),
            F.when(speed > 0, F.least(acc["hi"], hit)).otherwise(acc["hi"]).alias("hi"),
        )

    start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))
    return F.aggregate(
        sides, start, narrow, lambda acc: F.greatest(F.lit(0.0), acc["hi"] - acc["lo"])
    )


def _with_crossings(df: DataFrame) -> DataFrame:
    """Add `_in` and `_out`, where between 0 and 1 a segment with `_ring` enters and leaves the polygon; not in order if it doesn't."""
    step = 2 * math.pi / C.BUFFER_SIDES
    ring, pick = F.col("_ring"), lambda column: F.when(F.col("_ring"), column).otherwise(0.0)
    at = df.withColumn("_root", pick(F.sqrt("_do"))).withColumns(
        {
            "_t0": pick((-F.col("_root") - F.col("_ad")) / F.col("_dd")),
            "_t1": pick((F.col("_root") - F.col("_ad")) / F.col("_dd")),
            # Towards larger or smaller angles.
            "_turn": F.when(F.col("_ax") * F.col("_dy") - F.col("_ay") * F.col("_dx") < 0, -1.0).otherwise(1.0),
        }
    )

    def middle(t: str) -> Column:
        """Angle of the middle of the side where the line meets the outer circle."""
        angle = F.atan2(F.col("_ay") + F.col(t) * F.col("_dy"), F.col("_ax") + F.col(t) * F.col("_dx"))
        return pick((F.floor(angle / step) + 0.5) * step)

    at = at.withColumns({"_m0": middle("_t0"), "_m1": middle("_t1")})
    at = at.withColumns({f"_{f}{i}": pick(fn(f"_m{i}")) for i in (0, 1) for f, fn in (("c", F.cos), ("s", F.sin))})
    turn, cos, sin = F.col("_turn"), math.cos(step), math.sin(step)
    sides = {}
    for i, back in ((0, 1.0), (1, -1.0)):
        c, s = F.col(f"_c{i}"), F.col(f"_s{i}")
        # The side itself and that of the sector further inside, by turning its normal.
        normals = (c, s), (c * cos - back * turn * s * sin, s * cos + back * turn * c * sin)
        for j, (nx, ny) in enumerate(normals):
            sides[f"_v{i}{j}"] = nx * F.col("_dx") + ny * F.col("_dy")
            sides[f"_w{i}{j}"] = F.col("_h") - (nx * F.col("_ax") + ny * F.col("_ay"))
    at = at.withColumns(sides)

    def hit(i: int, j: int) -> Column:
        speed, room = F.col(f"_v{i}{j}"), F.col(f"_w{i}{j}")
        if i == 0:
            return F.when(speed < 0, room / speed).otherwise(0.0)
        # A line along a side and outside of it never is in the polygon.
        return F.when(speed > 0, room / speed).when((speed == 0) & (room < 0), -1.0).otherwise(1.0)

    return at.withColumns(
        {
            "_in": F.when(ring, F.greatest(F.lit(0.0), F.col("_t0"), hit(0, 0), hit(0, 1))),
            "_out": F.when(ring, F.least(F.lit(1.0), F.col("_t1"), hit(1, 0), hit(1, 1))),
        }
    )


def with_clipped_length(
    df: DataFrame, out: str, px: str, py: str, radius: str, ends: Sequence[str], grazing=True
) -> DataFrame:
    """Add the length of the part of each segment inside the buffer polygon around (px, py).

    A segment with both ends in the polygon's inner circle counts whole, one that stays outside the outer circle
    not at all. Another one is a + t * d, t in [0, 1], around the centre: its line passes the ring between the two
    circles within half a sector's angle on each way, so the side of the sector where it meets the outer circle and that of
    the sector before it (on the way out; behind it on the way in) bound it. `grazing=False` bounds every segment by all sides.
    """
    step = 2 * math.pi / C.BUFFER_SIDES
    x1, y1, x2, y2 = (F.col(c) for c in ends)
    keep = df.columns
    at = df.withColumns(
        {
            "_ax": x1 - F.col(px),
            "_ay": y1 - F.col(py),
            "_dx": x2 - x1,
            "_dy": y2 - y1,
            "_h": F.col(radius) * math.cos(step / 2),
        }
    )
    at = at.withColumns(
        {
            "_dd": F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy"),
            "_ad": F.col("_ax") * F.col("_dx") + F.col("_ay") * F.col("_dy"),
            "_aa": F.col("_ax") * F.col("_ax") + F.col("_ay") * F.col("_ay"),
        }
    )
    at = at.withColumn("_do", F.col("_ad") * F.col("_ad") - F.col("_dd") * (F.col("_aa") - F.col(radius) * F.col(radius)))
    share = F.when(F.col("_do").isNull() | (F.col("_do") <= 0), F.lit(0.0))
    if not grazing:
        return at.withColumn(out, share.otherwise(_share_by_sides()) * F.sqrt("_dd")).select(*keep, out)
    # Square of the distance of the far end, which is a + d.
    bb = F.col("_aa") + 2 * F.col("_ad") + F.col("_dd")
    reach_sq, inner_sq = F.col(radius) * F.col(radius), F.col("_h") * F.col("_h") * (1 - 1e-12)
    behind = (F.col("_ad") >= 0) & (F.col("_aa") >= reach_sq)
    ahead = (F.col("_ad") + F.col("_dd") <= 0) & (bb >= reach_sq)
    share = share.when(behind | ahead, F.lit(0.0)).when((F.col("_aa") < inner_sq) & (bb < inner_sq), F.lit(1.0))
    at = at.withColumn("_easy", share)
    at = _with_crossings(at.withColumn("_ring", F.col("_easy").isNull()))
    share = F.coalesce("_easy", F.greatest(F.lit(0.0), F.col("_out") - F.col("_in")))
    return at.withColumn(out, share * F.sqrt("_dd")).select(*keep, out)


def pixel_coordinates(lat, lon) -> tuple[Column, Column]:
    """(x, y) pixel of the rural/urban raster; the far edges belong to the last pixel."""
    left, _, _, top = C.RU_EXTENT
    x = F.floor(F.abs(F.lit(left) - _col(lon)) / C.RU_PIXEL_WIDTH)
    y = F.floor(F.abs(F.lit(top) - _col(lat)) / C.RU_PIXEL_HEIGHT)
    x = F.when(x == C.RU_COLUMNS, C.RU_COLUMNS - 1).otherwise(x)
    y = F.when(y == C.RU_ROWS, C.RU_ROWS - 1).otherwise(y)
    return x.cast("int"), y.cast("int")
