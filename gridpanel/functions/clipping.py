"""Lengths of many segments inside the buffer polygons around many places, without a clip for each pair; nearest segments.

Segments are cut at the lines of a grid, so a piece lies in one cell. Seen from a place, most cells that its polygon's rim crosses lie
within the sector of one side. There the polygon is a half-plane, and the length inside of all pieces of a cell depends on one number,
how far along the side's normal the rim lies: a sum of ramps, read from running sums over sorted ends. Only in cells that
span several sectors are pieces clipped one by one, by the sides of these sectors.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa

from gridpanel import constants as C

SIDES = C.BUFFER_SIDES
STEP = 2 * math.pi / SIDES
_NORMALS = (np.arange(SIDES) + 0.5) * STEP
NX, NY = np.cos(_NORMALS), np.sin(_NORMALS)
# Cells along one side of the grid at most, and numbers handled together.
MOST_CELLS, CHUNK = 32, 1 << 15
# Segments and places of a cell handled together.
SEGMENTS, PLACES = 1 << 13, 1 << 16
# Pieces that lean less than this against a side have no ramp but are clipped by it.
FLAT = 1e-3


def _cut(at: np.ndarray, other: np.ndarray, start: np.ndarray, end: np.ndarray, width: float, cells: int):
    """Intervals [start, end] of segments from `at` to `other` on one axis, cut at grid lines: (row, start, end, cell)."""
    step = other - at
    low, high = at + start * step, at + end * step
    first = np.clip(np.floor(np.minimum(low, high) / width), 0, cells - 1).astype(np.int64)
    last = np.clip(np.floor(np.maximum(low, high) / width), 0, cells - 1).astype(np.int64)
    count = last - first + 1
    row = np.repeat(np.arange(at.size), count)
    place = np.arange(row.size) - np.repeat(np.cumsum(count) - count, count)
    cell = first[row] + place
    with np.errstate(divide="ignore", invalid="ignore"):
        t0, t1 = (cell * width - at[row]) / step[row], ((cell + 1) * width - at[row]) / step[row]
    enter, leave = np.minimum(t0, t1), np.maximum(t0, t1)
    # The outermost pieces end where the segment does.
    ahead = step[row] >= 0
    at_first, at_last = place == 0, cell == last[row]
    own_start, own_end = np.where(ahead, at_first, at_last), np.where(ahead, at_last, at_first)
    return row, np.where(own_start, start[row], enter), np.where(own_end, end[row], leave), cell


def _fewer(first, left, right, low, high, inner):
    """First side and number of sides that bound the polygon in boxes which lie in the sectors `first` and `first` + 1.

    The line of a side crosses a box that has no vertex of the polygon in it either where the side is or beyond its end. A box
    that only one of two sides crosses is bounded by its line alone; where a line leaves the whole box out, so does the polygon.
    """
    end = inner * math.tan(STEP / 2)
    edge_x, edge_y = inner / math.cos(STEP / 2) * np.cos((first + 1) * STEP), inner / math.cos(STEP / 2) * np.sin((first + 1) * STEP)
    slack = 1e-9 * inner
    vertex = (edge_x > left - slack) & (edge_x < right + slack) & (edge_y > low - slack) & (edge_y < high + slack)
    crossed, outside = [], []
    for side, sign in ((0, 1.0), (1, -1.0)):
        nx, ny = NX[(first + side) % SIDES], NY[(first + side) % SIDES]
        x, y = np.stack([left, left, right, right]), np.stack([low, high, low, high])
        over = nx * x + ny * y - inner
        along = nx * y - ny * x
        most, least = over.argmax(axis=0), over.argmin(axis=0)
        rows = np.arange(first.size)
        above, below = over[most, rows], over[least, rows]
        with np.errstate(divide="ignore", invalid="ignore"):
            at = along[least, rows] + (along[most, rows] - along[least, rows]) * (-below / (above - below))
        meets = (above > 0) & (below < 0)
        crossed.append(meets & (sign * at < end))
        outside.append(below >= 0)
    neither, both = ~crossed[0] & ~crossed[1], crossed[0] & crossed[1]
    count = np.where(vertex | both | neither, 2, 1)
    count = np.where(outside[0] | outside[1], 0, count)
    return np.where((count == 1) & crossed[1], first + 1, first), count


def _clipped(x, y, dx, dy, length, first, sides, inner):
    """Lengths inside the sides `first` and the `sides - 1` behind it, of segments that start at (x, y) as seen from the center."""
    low, high = np.zeros(x.size), np.ones(x.size)
    for j in range(int(sides.max(initial=0))):
        k = (first + np.minimum(j, sides - 1)) % SIDES
        nx, ny = NX[k], NY[k]
        speed, room = nx * dx + ny * dy, inner - (nx * x + ny * y)
        with np.errstate(divide="ignore", invalid="ignore"):
            hit = room / speed
        low = np.where(speed < 0, np.maximum(low, hit), np.where((speed == 0) & (room < 0), 2.0, low))
        high = np.where(speed > 0, np.minimum(high, hit), high)
    return length * np.maximum(0.0, high - low)


def buffer_lengths(ends: np.ndarray, kind: np.ndarray, kinds: int, cx: np.ndarray, cy: np.ndarray, radius: float, cells: int | None = None) -> np.ndarray:
    """Length inside the polygon around each place (`cx`, `cy`) of the segments of each kind, 0 to `kinds` - 1.

    `ends` has rows x1, y1, x2, y2. Segments and places that are not finite add nothing.
    """
    out = np.zeros((cx.size, kinds))
    good = np.isfinite(ends).all(axis=0)
    (x1, y1, x2, y2), kind = ends[:, good], kind[good]
    if not x1.size or not cx.size:
        return out
    if cells is None:
        cells = min(MOST_CELLS, 1 << max(0, round(math.log2(max(1.0, math.sqrt(x1.size) / 3)))))
    # Near the segments, numbers are small and sums of them exact enough.
    ox, oy = min(x1.min(), x2.min()), min(y1.min(), y2.min())
    x1, x2, y1, y2, cx, cy = x1 - ox, x2 - ox, y1 - oy, y2 - oy, cx - ox, cy - oy
    width = max(x1.max(), x2.max(), y1.max(), y2.max()) * (1 + 1e-9) / cells or 1.0
    inner = radius * math.cos(STEP / 2)
    east, north = max(x1.max(), x2.max()), max(y1.max(), y2.max())
    far = np.hypot(np.maximum(cx, east - cx), np.maximum(cy, north - cy))
    near = np.hypot(np.maximum(np.maximum(-cx, cx - east), 0), np.maximum(np.maximum(-cy, cy - north), 0))
    whole = far < inner * (1 - 1e-12)
    out[whole] = np.bincount(kind, np.hypot(x2 - x1, y2 - y1), kinds)
    reached = np.flatnonzero(~whole & (near < radius * (1 + 1e-12)))
    if not reached.size:
        return out
    result, out, cx, cy = out, np.zeros((reached.size, kinds)), cx[reached], cy[reached]

    row, t0, t1, ix = _cut(x1, x2, np.zeros(x1.size), np.ones(x1.size), width, cells)
    sub, t0, t1, iy = _cut(y1[row], y2[row], t0, t1, width, cells)
    row, ix = row[sub], ix[sub]
    real = t1 > t0
    row, ix, iy, t0, t1 = row[real], ix[real], iy[real], t0[real], t1[real]
    plane = cells * cells
    cell = kind[row] * plane + iy * cells + ix
    order = np.argsort(cell, kind="stable")
    row, t0, t1, cell = row[order], t0[order], t1[order], cell[order]
    dx, dy = x2[row] - x1[row], y2[row] - y1[row]
    px, py, dx, dy = x1[row] + t0 * dx, y1[row] + t0 * dy, (t1 - t0) * dx, (t1 - t0) * dy
    length = np.hypot(dx, dy)
    begin = np.searchsorted(cell, np.arange(kinds * plane + 1))
    totals = np.bincount(cell, length, kinds * plane).reshape(kinds, plane)
    used = (totals > 0).any(axis=0)

    one, many = [], []
    lines = np.arange(cells + 1) * width
    for at in range(0, cx.size, max(1, CHUNK // (cells + 1) ** 2)):
        some = slice(at, at + max(1, CHUNK // (cells + 1) ** 2))
        gx, gy = lines - cx[some, None], lines - cy[some, None]
        far_x, far_y = np.maximum(-gx[:, :-1], gx[:, 1:]), np.maximum(-gy[:, :-1], gy[:, 1:])
        near_x, near_y = np.maximum(np.maximum(gx[:, :-1], -gx[:, 1:]), 0), np.maximum(np.maximum(gy[:, :-1], -gy[:, 1:]), 0)
        far = (far_y * far_y)[:, :, None] + (far_x * far_x)[:, None, :]
        near = (near_y * near_y)[:, :, None] + (near_x * near_x)[:, None, :]
        within = (far < inner * inner * (1 - 1e-12)).reshape(-1, plane)
        out[some] += within @ totals.T
        rim = ~within & (near < radius * radius * (1 + 1e-12)).reshape(-1, plane) & used
        c, q = np.nonzero(rim)
        qy, qx = np.divmod(q, cells)
        left, right, low, high = gx[c, qx], gx[c, qx + 1], gy[c, qy], gy[c, qy + 1]
        sector = np.stack([np.floor(np.arctan2(v, u) / STEP).astype(np.int64) for u in (left, right) for v in (low, high)])
        # Behind the place, angles jump by a whole turn.
        sector += SIDES * ((sector < 0) & (right < 0) & (low < 0) & (high >= 0))
        first, last = sector.min(axis=0), sector.max(axis=0)
        around = (left <= 0) & (right >= 0) & (low <= 0) & (high >= 0)
        sides = np.minimum(np.where(around, SIDES, last - first + 1), SIDES)
        two = np.flatnonzero(sides == 2)
        first[two], sides[two] = _fewer(first[two], *(v[two] for v in (left, right, low, high)), inner)
        for chosen, found in ((sides == 1, one), (sides > 1, many)):
            numbers = c[chosen] + at, q[chosen], first[chosen], sides[chosen]
            found.append(np.stack(numbers).astype(np.int32))
    one, many = np.concatenate(one, axis=1), np.concatenate(many, axis=1)

    def spread(count: np.ndarray, start: np.ndarray):
        """Pairs, and the numbers of the pieces that each has from `start`, in parts."""
        done, low = np.cumsum(count), 0
        while low < count.size:
            high = max(low + 1, int(np.searchsorted(done, done[low] - count[low] + CHUNK)))
            n = count[low:high]
            pair = np.repeat(np.arange(low, high), n)
            yield pair, np.arange(pair.size) - np.repeat(np.cumsum(n) - n - start[low:high], n)
            low = high

    def clip(pairs: np.ndarray, kind_: int, start: np.ndarray, pieces: np.ndarray | None) -> None:
        """Add the pieces of a cell to a place, one by one; `pieces` are those meant, in order of cells."""
        at = kind_ * plane + pairs[1]
        count = start[at + 1] - start[at]
        for pair, piece in spread(count, start[at]):
            piece = piece if pieces is None else pieces[piece]
            c, _, first, sides = pairs[:, pair]
            part = _clipped(px[piece] - cx[c], py[piece] - cy[c], dx[piece], dy[piece], length[piece], first, sides, inner)
            out[:, kind_] += np.bincount(c, part, out.shape[0])

    def clip_by_two(pairs: np.ndarray, k: int) -> None:
        """Add the pieces of cells that the sides `k` and the next one bound to a place."""
        (ax, bx), (ay, by) = NX[[k, (k + 1) % SIDES]], NY[[k, (k + 1) % SIDES]]
        lean = ax * dx + ay * dy
        # Pieces run towards the first side, so it bounds their ends.
        x, y = np.where(lean < 0, px + dx, px), np.where(lean < 0, py + dy, py)
        other = np.where(lean < 0, -1.0, 1.0) * (bx * dx + by * dy)
        with np.errstate(divide="ignore"):
            speed_a, speed_b = 1 / np.abs(lean), 1 / (other + 0.0)
        start_a, start_b, towards = ax * x + ay * y, bx * x + by * y, other >= 0
        level_a, level_b = (inner + u * cx[pairs[0]] + v * cy[pairs[0]] for u, v in ((ax, ay), (bx, by)))
        for g in range(kinds):
            at = g * plane + pairs[1]
            for pair, piece in spread(begin[at + 1] - begin[at], begin[at]):
                with np.errstate(invalid="ignore"):
                    a = (level_a[pair] - start_a[piece]) * speed_a[piece]
                    b = (level_b[pair] - start_b[piece]) * speed_b[piece]
                ahead = towards[piece]
                # A piece along a side and on it is inside; its bound is no number, which fmin passes over.
                high = np.fmin(1.0, np.fmin(a, np.where(ahead, b, 1.0)))
                low = np.where(ahead, 0.0, np.fmax(b, 0.0))
                part = length[piece] * np.maximum(0.0, high - low)
                out[:, g] += np.bincount(pairs[0, pair], part, out.shape[0])

    two = many[:, many[3] == 2]
    by_vertex = np.argsort(two[2] % SIDES, kind="stable")
    two = two[:, by_vertex]
    edges = np.searchsorted(two[2] % SIDES, np.arange(SIDES + 1))
    for k in range(SIDES):
        if edges[k] < edges[k + 1]:
            clip_by_two(two[:, edges[k] : edges[k + 1]], k)
    many = many[:, many[3] > 2]
    for g in range(kinds):
        clip(many, g, begin, None)
    side = one[2] % SIDES
    by_side = np.argsort(side % (SIDES // 2), kind="stable")
    one, side = one[:, by_side], side[by_side]
    edges = np.searchsorted(side % (SIDES // 2), np.arange(SIDES // 2 + 1))
    span = 4 * width
    corner_y, corner_x = np.divmod(cell % plane, cells)
    for k in range(SIDES // 2):
        pairs = one[:, edges[k] : edges[k + 1]]
        if not pairs.size:
            continue
        back = side[edges[k] : edges[k + 1]] != k
        # Places along the normal, from the cell's corner, and from the middle of the cell's own stretch of the keys.
        a = NX[k] * (px - corner_x * width) + NY[k] * (py - corner_y * width)
        lean = NX[k] * dx + NY[k] * dy
        flat = np.abs(lean) < FLAT * length
        slope = np.where(flat | (length == 0), 0.0, length / np.where(flat | (length == 0), 1.0, np.abs(lean)))
        sums = []
        for end in (np.minimum(a, a + lean), np.maximum(a, a + lean)):
            key = cell * span + span / 2 + end
            order = np.argsort(key)
            grown = np.concatenate([[0.0], np.cumsum(slope[order])]), np.concatenate([[0.0], np.cumsum(slope[order] * end[order])])
            sums.append((key[order], *grown))
        rest = np.bincount(cell, np.where(flat, 0.0, length), kinds * plane)
        flats = np.flatnonzero(flat)
        flat_begin = np.searchsorted(cell[flats], np.arange(kinds * plane + 1))
        qy, qx = np.divmod(pairs[1], cells)
        level = NX[k] * (cx[pairs[0]] - qx * width) + NY[k] * (cy[pairs[0]] - qy * width) + np.where(back, -inner, inner)
        level = np.clip(level, -span / 2, span / 2)
        for g in range(kinds):
            at = g * plane + pairs[1]
            key, start = at * span + span / 2 + level, begin[at]
            risen = []
            for keys, slopes, moments in sums:
                upto = np.clip(np.searchsorted(keys, key, "right"), start, begin[at + 1])
                risen.append((slopes[upto] - slopes[start]) * level - (moments[upto] - moments[start]))
            below = risen[0] - risen[1]
            out[:, g] += np.bincount(pairs[0], np.where(back, rest[at] - below, below), out.shape[0])
            if flats.size:
                clip(pairs, g, flat_begin, flats)
    result[reached] = np.maximum(out, 0.0)
    return result


def _near_each_other(lines: np.ndarray) -> list[np.ndarray]:
    """Numbers of the segments in parts of at most SEGMENTS, by where their middles lie."""
    n = lines.shape[1]
    if n <= SEGMENTS:
        return [np.arange(n)]
    side = math.ceil(math.sqrt(n / SEGMENTS))
    block = np.zeros(n, dtype=np.int64)
    for middle in (lines[0] + lines[2], lines[1] + lines[3]):
        low, high = np.nanmin(middle), np.nanmax(middle)
        place = (middle - low) / (high - low or 1.0) * side
        block = block * side + np.clip(np.nan_to_num(place), 0, side - 1).astype(np.int64)
    order = np.argsort(block, kind="stable")
    blocks = np.split(order, np.flatnonzero(np.diff(block[order])) + 1)
    return [b[at : at + SEGMENTS] for b in blocks for at in range(0, b.size, SEGMENTS)]


def lengths_in_cell(radius: float, kind: str, ends: tuple[str, ...], schema: pa.Schema):
    """For `applyInArrow`: lengths (`_x`, `_y`, `kind`, `_part`) around the places of a cell, of its segments of each kind."""

    def run(places: pa.Table, segments: pa.Table) -> pa.Table:
        cx, cy = (places.column(c).to_numpy() for c in ("_x", "_y"))
        codes = segments.column(kind).combine_chunks().dictionary_encode()
        lines, code = np.stack([segments.column(c).to_numpy() for c in ends]), codes.indices.to_numpy()
        names, found, blocks = codes.dictionary, [], _near_each_other(lines)
        for at in range(0, cx.size, PLACES):
            x, y = cx[at : at + PLACES], cy[at : at + PLACES]
            part = np.zeros((x.size, len(names)))
            for some in blocks:
                part += buffer_lengths(lines[:, some], code[some], len(names), x, y, radius)
            place, which = np.nonzero(part)
            columns = [x[place], y[place], names.take(pa.array(which)), part[place, which]]
            found.append(pa.Table.from_arrays([pa.array(c) for c in columns], schema=schema))
        return pa.concat_tables(found) if found else schema.empty_table()

    return run


def nearest_in_cell(ends: tuple[str, ...], schema: pa.Schema):
    """For `applyInArrow`: the distance (`_x`, `_y`, `_near`) from the places of a cell to the nearest of its segments, NULL without any."""

    def run(places: pa.Table, segments: pa.Table) -> pa.Table:
        cx, cy = (places.column(c).to_numpy() for c in ("_x", "_y"))
        lines = np.stack([segments.column(c).to_numpy() for c in ends])
        x1, y1, x2, y2 = lines[:, np.isfinite(lines).all(axis=0)]
        dx, dy = x2 - x1, y2 - y1
        squares = dx * dx + dy * dy
        inverse = np.divide(1.0, squares, out=np.zeros(squares.size), where=squares > 0)
        nearest = np.full(cx.size, np.inf)
        wide = min(max(1, x1.size), CHUNK)
        for low in range(0, x1.size, wide):
            some = slice(low, low + wide)
            for at in range(0, cx.size, max(1, CHUNK // wide)):
                rows = slice(at, at + max(1, CHUNK // wide))
                ax, ay = cx[rows, None] - x1[some], cy[rows, None] - y1[some]
                along = np.clip((ax * dx[some] + ay * dy[some]) * inverse[some], 0.0, 1.0)
                ax -= along * dx[some]
                ay -= along * dy[some]
                nearest[rows] = np.fmin(nearest[rows], (ax * ax + ay * ay).min(axis=1))
        near = pa.array(np.sqrt(nearest), mask=~np.isfinite(nearest))
        return pa.Table.from_arrays([pa.array(cx), pa.array(cy), near], schema=schema)

    return run
