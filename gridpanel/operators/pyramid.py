"""Grid cells over items with bounding boxes, searched by equi-joins.

The grid divides the globe; nothing is measured beforehand. Coordinates off the globe fall
into the cells at its rim and change no other cell. Every item (a point or a road segment)
belongs to one cell per level, by its midpoint, and a cell carries the bounding box of its items.

Where the radius is known, a pyramid has 4 x 4 children to a cell, and its levels follow from the radius
alone. A search starts at the level whose cells are about as wide as the radius, with the
few cells a circle can touch there; each further level is an equi-join on the cell. Cells that lie wholly
inside a search circle are answered from their totals without visiting their items.

Without a radius (the nearest segment), segments are sorted into the cells of one size that they pass through, and most places find
the nearest within their own. For the others, a tree of 16 x 16 children to a cell holds the cells that are passed; it splits only cells that hold too
many items, so its leaves lie at different depths: many where items crowd together, none
where there are none, and an item far from all others changes no cell but its own. It is a table of split
cells and their children; a place finds its own cell in it by the prefixes of its coordinates, and a search follows
children whose boxes are near enough.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridpanel.functions import spatial

BROADCAST_LEVELS = 4  # 16 ** 4 = 65,536 cells at most
LEAF_ITEMS = 64
# Levels of the tree, 4 bits of each coordinate a level; children of the first two are 65,792 at most.
TREE_LEVELS, TREE_BITS, TREE_BROADCAST = 7, 4, 2
# The globe in degrees, and cell numbers that fit one half of a long.
GLOBE_LOW, GLOBE_SIDE, FINEST = -180.0, 360.0, 15
# Levels below the one whose cells are about as wide as the radius: 16 to 64 cells across it.
RADIUS_LEVELS = 3
# Cells that segments pass through: 2 ** 15 to a side of the globe, some 1.2 km wide.
PASSED_BITS = 15
# Items that one row of a block holds, in expectation.
BLOCK_ITEMS = 4096
BOX = ("_xlo", "_ylo", "_xhi", "_yhi")
# Pruning must not lose a point to rounding.
SLACK = 1.0 + 1e-12


def unbroadcast(side: DataFrame) -> DataFrame:
    """A side of a join that grows with the data, kept from being broadcast.

    Before a join has run, Spark takes a side's size from the compressed columns that it reads, without the copies that
    explode makes of its rows.
    """
    return side.hint("merge")


@dataclass(frozen=True)
class Pyramid:
    """Items with their leaf coordinates `_ix`, `_iy` and box columns."""

    items: DataFrame
    depth: int
    x0: float
    y0: float
    side: float
    reach: float  # half the widest item box

    def cell(self, level: int) -> Column:
        """Cell id of an item at a level, from its leaf coordinates."""
        shift = 2 * (self.depth - level)
        ix, iy = F.shiftright("_ix", shift), F.shiftright("_iy", shift)
        return F.shiftleft(ix, 32).bitwiseOR(iy)

    def cell_side(self, level: int) -> float:
        return self.side / 4**level

    def nodes(self, level: int) -> DataFrame:
        """(_parent, _child, box) of a level; rolled up from the leaf cells."""
        box = [
            F.min("_xlo").alias("_xlo"),
            F.min("_ylo").alias("_ylo"),
            F.max("_xhi").alias("_xhi"),
            F.max("_yhi").alias("_yhi"),
        ]
        leaves = self.items.groupBy("_ix", "_iy").agg(*box)
        parent = self.cell(level - 1).alias("_parent")
        nodes = leaves.groupBy(parent, self.cell(level).alias("_child")).agg(*box)
        return F.broadcast(nodes) if level <= BROADCAST_LEVELS else unbroadcast(nodes)


def _leaf(value: Column, low: float, side: float, depth: int) -> Column:
    """Leaf coordinate; what lies outside the grid falls into its outermost cells."""
    at = F.floor((value - low) / (side / 4**depth))
    return F.least(F.lit(4**depth - 1), F.greatest(F.lit(0), at)).cast("long")


def _middle(low: str, high: str) -> Column:
    return (F.col(low) + F.col(high)) / 2


def radius_grid(items: DataFrame, radius: float, levels: int = RADIUS_LEVELS, reach: float = 0.0) -> Pyramid:
    """Pyramid for searches with one radius; `reach` is half of the widest box that an item may have."""
    depth = 0
    while GLOBE_SIDE / 4 ** (depth + 1) >= radius and depth < FINEST:
        depth += 1
    depth = max(1, min(depth + levels, FINEST))
    located = items.withColumns(
        {
            "_ix": _leaf(_middle("_xlo", "_xhi"), GLOBE_LOW, GLOBE_SIDE, depth),
            "_iy": _leaf(_middle("_ylo", "_yhi"), GLOBE_LOW, GLOBE_SIDE, depth),
        }
    )
    return Pyramid(located, depth, GLOBE_LOW, GLOBE_LOW, GLOBE_SIDE, reach)


@dataclass(frozen=True)
class Tree:
    """Items with finest coordinates `_ix`, `_iy`, and a row for each split cell: `_cell`, `_lvl`, its children `_kids`."""

    items: DataFrame
    split: DataFrame

    def level(self, level: int) -> DataFrame:
        cells = self.split.filter(F.col("_lvl") == level).select(F.col("_cell").alias("_parent"), "_kids")
        return F.broadcast(cells) if level < TREE_BROADCAST else unbroadcast(cells)


# A cell of the tree is its level and its two coordinates at that level in one long.
_HALF = TREE_LEVELS * TREE_BITS


def _tree_cell(level: Column, ix: Column, iy: Column) -> Column:
    return F.shiftleft(level, 2 * _HALF).bitwiseOR(F.shiftleft(ix, _HALF)).bitwiseOR(iy)


def _prefixes(levels: range) -> Column:
    """Cells of finest coordinates at several levels."""
    shift = lambda level: TREE_BITS * (TREE_LEVELS - level)
    at = lambda level: (F.shiftright("_ix", shift(level)), F.shiftright("_iy", shift(level)))
    return F.explode(F.array(*[_tree_cell(F.lit(n).cast("long"), *at(n)) for n in levels])).alias("_cell")


def _tree_parent(cell: Column) -> Column:
    low = F.lit((1 << _HALF) - 1)
    level, ix, iy = F.shiftright(cell, 2 * _HALF), F.shiftright(cell, _HALF).bitwiseAND(low), cell.bitwiseAND(low)
    return _tree_cell(level - 1, F.shiftright(ix, TREE_BITS), F.shiftright(iy, TREE_BITS))


def _finest(x: Column, y: Column) -> dict[str, Column]:
    depth = TREE_LEVELS * TREE_BITS // 2
    return {"_ix": _leaf(x, GLOBE_LOW, GLOBE_SIDE, depth), "_iy": _leaf(y, GLOBE_LOW, GLOBE_SIDE, depth)}


def build_tree(items: DataFrame, leaf_items: int = LEAF_ITEMS) -> Tree:
    """Tree over items that carry the box columns; a cell is split if it holds more than `leaf_items`, the root always.

    Cells of the last level are leaves whatever they hold. Nothing runs here.
    """
    located = items.withColumns(_finest(_middle("_xlo", "_xhi"), _middle("_ylo", "_yhi")))
    boxes = [F.min("_xlo").alias("_xlo"), F.min("_ylo").alias("_ylo"), F.max("_xhi").alias("_xhi"), F.max("_yhi").alias("_yhi")]
    # Items of one finest cell combine first, so a cell is copied to its levels and not each of its items.
    cells = located.groupBy("_ix", "_iy").agg(F.count(F.lit(1)).alias("_n"), *boxes)
    nodes = cells.select(_prefixes(range(1, TREE_LEVELS + 1)), "_n", *BOX)
    nodes = nodes.groupBy("_cell").agg(F.sum("_n").alias("_n"), *boxes)
    level = F.shiftright("_cell", 2 * _HALF)
    leaf = (F.col("_n") <= leaf_items) | (level == TREE_LEVELS)
    kid = F.struct(F.col("_cell").alias("cell"), leaf.alias("leaf"), *BOX)
    # The level is an aggregate, so that all levels are read from one shuffle of cells.
    parents = nodes.groupBy(_tree_parent(F.col("_cell")).alias("_cell")).agg(
        F.max(level - 1).alias("_lvl"), F.sum("_n").alias("_n"), F.collect_list(kid).alias("_kids")
    )
    return Tree(located, parents.filter((F.col("_n") > leaf_items) | (F.col("_lvl") == 0)))


def _box(kid: Column) -> list[Column]:
    return [kid[b] for b in BOX]


def tree_bound(centers: DataFrame, tree: Tree) -> DataFrame:
    """Centers (`_x`, `_y`) with `_r`, a distance within which each has at least one item; none without items.

    Of the split cells that a center lies in, found by its prefixes, each child has an item no further
    than its far corner.
    """
    far = F.array_min(F.transform("_kids", lambda k: spatial.box_max_sq("_x", "_y", *_box(k))))
    placed = centers.withColumns(_finest(F.col("_x"), F.col("_y")))
    top, rest = range(TREE_BROADCAST), range(TREE_BROADCAST, TREE_LEVELS)

    def bounds(levels: range, cells: DataFrame) -> DataFrame:
        return placed.select("_x", "_y", _prefixes(levels)).join(cells, "_cell").select("_x", "_y", far.alias("_far"))

    upper = tree.split.filter(F.col("_lvl") < TREE_BROADCAST)
    lower = tree.split.filter(F.col("_lvl") >= TREE_BROADCAST)
    found = bounds(top, F.broadcast(upper)).union(bounds(rest, unbroadcast(lower)))
    return found.groupBy("_x", "_y").agg((F.sqrt(F.min("_far")) * SLACK).alias("_r"))


def tree_leaves(centers: DataFrame, tree: Tree) -> DataFrame:
    """(`_x`, `_y`, `_r`, `_cell`) of the leaves whose boxes lie within `_r` of a center."""
    reach_sq = F.col("_r") * F.col("_r") * SLACK
    at = ["_x", "_y", "_r"]
    front = centers.select(*at, F.lit(0).cast("long").alias("_cell"), F.lit(False).alias("_leaf"))
    for level in range(TREE_LEVELS):
        near = F.filter("_kids", lambda k: spatial.box_min_sq("_x", "_y", *_box(k)) <= reach_sq)
        below = F.transform(near, lambda k: F.struct(k["cell"].alias("_cell"), k["leaf"].alias("_leaf")))
        # A leaf found above stays as it is.
        same = F.array(F.struct("_cell", "_leaf"))
        match = (F.col("_cell") == F.col("_parent")) & ~F.col("_leaf")
        joined = front.join(tree.level(level), match, "left")
        front = joined.select(*at, F.inline(F.when(F.col("_leaf"), same).otherwise(below)))
    return front.select(*at, "_cell")


def tree_items(tree: Tree, columns: Sequence[str]) -> DataFrame:
    """Items at the cells of all levels; only that of its leaf is ever asked for."""
    return tree.items.select(_prefixes(range(1, TREE_LEVELS + 1)), *columns)


def _passed(value: Column, low: float) -> Column:
    return F.least(F.lit(2**PASSED_BITS - 1), F.greatest(F.lit(0), F.floor((value - low) / _PASSED_SIDE))).cast("long")


_PASSED_SIDE = GLOBE_SIDE / 2**PASSED_BITS


def passed_cell(x: Column, y: Column) -> Column:
    """Cell of a place, of those that segments are sorted into."""
    return F.shiftleft(_passed(x, GLOBE_LOW), 32).bitwiseOR(_passed(y, GLOBE_LOW))


def rim_distance(x: Column, y: Column) -> Column:
    """How far a place is from the rim of its cell; negative off the globe, and a little less than true."""
    gaps = []
    for value in (x, y):
        low = GLOBE_LOW + _passed(value, GLOBE_LOW) * _PASSED_SIDE
        gaps += [value - low, low + _PASSED_SIDE - value]
    return F.least(*gaps) - 1e-12


def passed_cells(segments: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Segments (x1, y1, x2, y2), boxed, once for each cell they pass through: `_cell`, `columns` and the box of what lies in it.

    Boxes are a little too wide, so no point of a segment is lost to rounding. A segment through many cells is as many rows.
    """
    slack = lambda value: (F.abs(value) + 1) * 1e-13
    xlo, xhi = F.col("_xlo"), F.col("_xhi")
    across = segments.withColumns({"_i0": _passed(xlo, GLOBE_LOW), "_i1": _passed(xhi, GLOBE_LOW)})
    across = across.withColumn("_i", F.explode(F.sequence("_i0", "_i1")))
    edge = GLOBE_LOW + F.col("_i") * _PASSED_SIDE
    across = across.withColumns(
        {
            "_a": F.when(F.col("_i") == F.col("_i0"), xlo).otherwise(edge),
            "_b": F.when(F.col("_i") == F.col("_i1"), xhi).otherwise(edge + _PASSED_SIDE),
        }
    )
    # One column of cells holds a whole segment, whichever way it leans.
    alone = F.col("_i0") == F.col("_i1")
    height = lambda x: F.col("y1") + (F.col(x) - F.col("x1")) * ((F.col("y2") - F.col("y1")) / (F.col("x2") - F.col("x1")))
    across = across.withColumns({"_ya": F.when(~alone, height("_a")), "_yb": F.when(~alone, height("_b"))})
    low, high = F.least("_ya", "_yb"), F.greatest("_ya", "_yb")
    across = across.withColumns(
        {
            "_c": F.when(alone, F.col("_ylo")).otherwise(F.greatest(low - slack(low), F.col("_ylo"))),
            "_d": F.when(alone, F.col("_yhi")).otherwise(F.least(high + slack(high), F.col("_yhi"))),
        }
    )
    across = across.withColumns({"_j0": _passed(F.col("_c"), GLOBE_LOW), "_j1": _passed(F.col("_d"), GLOBE_LOW)})
    cells = across.withColumn("_j", F.explode(F.sequence("_j0", "_j1")))
    edge = GLOBE_LOW + F.col("_j") * _PASSED_SIDE
    below = F.when(F.col("_j") == F.col("_j0"), F.col("_c")).otherwise(edge)
    above = F.when(F.col("_j") == F.col("_j1"), F.col("_d")).otherwise(edge + _PASSED_SIDE)
    return cells.select(
        F.shiftleft("_i", 32).bitwiseOR(F.col("_j")).alias("_cell"),
        *columns,
        (F.col("_a") - slack(F.col("_a"))).alias("_xlo"),
        (below - slack(below)).alias("_ylo"),
        (F.col("_b") + slack(F.col("_b"))).alias("_xhi"),
        (above + slack(above)).alias("_yhi"),
    )


def spread(centers: DataFrame) -> DataFrame:
    """Centers over all shuffle partitions, whatever their size in bytes.

    One center meets many cells and items, so a partition that looks small is not. No
    keys are named: by its keys, the shuffle would be merged with the one before it.
    """
    return centers.repartition(
        int(centers.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    )


def start_level(pyramid: Pyramid, radius: float) -> int:
    """Finest level whose cells are at least as wide as the radius."""
    level = 0
    while level < pyramid.depth and pyramid.cell_side(level + 1) >= radius:
        level += 1
    return level


def _touched(pyramid: Pyramid, level: int, at: str, low: float, reach: Column) -> Column:
    """Cell coordinates along one axis that a circle can touch, with the rim as in `_leaf`."""
    side, last = pyramid.cell_side(level), F.lit(4**level - 1)
    first = F.greatest(F.lit(0), F.least(last, F.floor((F.col(at) - reach - low) / side)))
    final = F.greatest(F.lit(0), F.least(last, F.floor((F.col(at) + reach - low) / side)))
    return F.sequence(first, final)


def search(
    centers: DataFrame,
    pyramid: Pyramid,
    keep: Sequence[str],
    radius: float,
    inner_share: float | None = None,
    deepest: int | None = None,
) -> DataFrame:
    """Cells within reach of every center (`_x`, `_y`), of the last level or of `deepest`.

    Result columns: `keep`, `_x`, `_y`, `_r`, `_lvl`, `_cell`, `_whole`. Leaf cells whose items must be
    tested have `_whole` false. With `inner_share`, cells below the start level that lie
    within that share of the radius are returned as `_whole` and not descended into.
    """
    at = [*keep, "_x", "_y", "_r"]
    reach_sq = F.col("_r") * F.col("_r") * SLACK
    start = start_level(pyramid, radius)
    reach = F.col("_r") * SLACK + pyramid.reach
    front = centers.withColumn("_r", F.lit(radius))
    front = front.select(
        *at,
        F.explode(_touched(pyramid, start, "_x", pyramid.x0, reach)).alias("_cx"),
        _touched(pyramid, start, "_y", pyramid.y0, reach).alias("_cys"),
    )
    front = front.select(*at, "_cx", F.explode("_cys").alias("_cy")).select(
        *at, F.shiftleft("_cx", 32).bitwiseOR(F.col("_cy")).alias("_cell")
    )
    front = front.select(
        *at, F.lit(start).alias("_lvl"), "_cell", F.lit(False).alias("_whole")
    )
    for level in range(start + 1, (pyramid.depth if deepest is None else deepest) + 1):
        near = spatial.box_min_sq("_x", "_y", *BOX) <= reach_sq
        nodes = pyramid.nodes(level)
        match = F.col("_cell") == F.col("_parent")
        if inner_share is not None and level > start + 1:
            front = front.join(nodes, match & ~F.col("_whole"), "left").filter(
                F.col("_whole") | F.coalesce(near, F.lit(False))
            )
        else:
            front = front.join(nodes, match).filter(near)
        whole = F.lit(False)
        if inner_share is not None:
            inner_sq = F.col("_r") * F.col("_r") * (inner_share**2) / SLACK
            whole = F.col("_whole") | (spatial.box_max_sq("_x", "_y", *BOX) < inner_sq)
        front = front.select(
            *at,
            F.when(F.col("_whole"), F.col("_lvl")).otherwise(F.lit(level)).alias("_lvl"),
            F.when(F.col("_whole"), F.col("_cell")).otherwise(F.col("_child")).alias("_cell"),
            whole.alias("_whole"),
        )
    return front


def _blocks(pyramid: Pyramid, level: int, by: Sequence[str], columns: Sequence[str], weight: str | None) -> DataFrame:
    """(`_cell`, `by`, box, `_sum`, `_kids`): cells of a level with all below them, nested down to the items.

    A row holds the items of one group, some BLOCK_ITEMS of them; a cell of more has several rows, by a hash of the places.
    """
    boxes = [F.min("_xlo").alias("_xlo"), F.min("_ylo").alias("_ylo"), F.max("_xhi").alias("_xhi"), F.max("_yhi").alias("_yhi")]
    total = F.sum(weight) if weight else F.count(F.lit(1))
    items = pyramid.items.withColumn("_cell", pyramid.cell(level))
    counts = items.groupBy("_cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ITEMS).alias("_rows"))
    row = F.pmod(F.xxhash64(*BOX), F.col("_rows"))
    key = ["_cell", "_row", *by]
    nested = items.join(unbroadcast(counts), "_cell").withColumn("_row", row).repartition(*key)
    item = F.struct(*dict.fromkeys([*columns, *BOX]))
    nested = nested.groupBy(*key, "_ix", "_iy").agg(F.collect_list(item).alias("_kids"), total.alias("_sum"), *boxes)
    for _ in range(level, pyramid.depth):
        up = [F.shiftright(i, 2).alias(i) for i in ("_ix", "_iy")]
        kid = F.struct(*BOX, "_sum", "_kids")
        nested = nested.groupBy(*key, *up).agg(F.collect_list(kid).alias("_kids"), F.sum("_sum").alias("_sum"), *boxes)
    return nested.select("_cell", *by, *BOX, "_sum", "_kids")


def search_items(
    centers: DataFrame,
    pyramid: Pyramid,
    keep: Sequence[str],
    radius: float,
    inner_share: float,
    by: Sequence[str],
    columns: Sequence[str],
    weight: str | None = None,
) -> DataFrame:
    """Items in cells within reach of every center: `keep`, `_x`, `_y`, `_r`, `by`, `_whole`, `_sum` and the struct `_item`.

    Centers are joined with cells a level below the start level, which carry what lies below them, so no step further down is
    shuffled: a center meets some dozen cells there, but thousands of leaves. Where `_whole` is true, the item is inside for
    certain; with `weight`, the rest of a cell that is inside then comes as one row with the sum of its weights and no item.
    """
    level = min(start_level(pyramid, radius) + 1, pyramid.depth)
    at = [*keep, "_x", "_y", "_r"]
    front = search(centers, pyramid, keep, radius, deepest=level).select(*at, "_cell")
    near = spatial.box_min_sq("_x", "_y", *BOX) <= F.col("_r") * F.col("_r") * SLACK
    inner = spatial.box_max_sq("_x", "_y", *BOX) < F.col("_r") * F.col("_r") * (inner_share**2) / SLACK
    found = front.join(unbroadcast(_blocks(pyramid, level, by, columns, weight)), "_cell")
    found = found.filter(near).withColumn("_whole", inner)
    below = F.explode_outer(F.when(~F.col("_whole"), F.col("_kids"))) if weight else F.explode("_kids")
    for _ in range(level, pyramid.depth):
        kids = found.select(*at, *by, "_whole", "_sum", below.alias("_kid"))
        found = kids.select(
            *at, *by, "_whole", *[F.col(f"_kid.{b}") for b in BOX], F.coalesce("_kid._sum", "_sum").alias("_sum"), "_kid._kids"
        )
        found = found.filter(F.col("_whole") | near).withColumn("_whole", F.col("_whole") | inner)
    return found.select(*at, *by, "_whole", "_sum", below.alias("_item"))


def leaf_items(pyramid: Pyramid, columns: Sequence[str]) -> DataFrame:
    return pyramid.items.select(
        F.lit(pyramid.depth).alias("_lvl"),
        pyramid.cell(pyramid.depth).alias("_cell"),
        F.lit(False).alias("_whole"),
        *columns,
    )


def with_totals(
    items: DataFrame, pyramid: Pyramid, radius: float, by: Sequence[str], weight: str
) -> DataFrame:
    """Leaf items, and below the start level the sum of a weight per cell and group."""
    start = start_level(pyramid, radius)
    if start == pyramid.depth:
        return items
    leaves = pyramid.items.groupBy("_ix", "_iy", *by).agg(F.sum(weight).alias(weight))
    cells = F.array(
        *[
            F.struct(F.lit(level).alias("_lvl"), pyramid.cell(level).alias("_cell"))
            for level in range(start + 1, pyramid.depth + 1)
        ]
    )
    totals = (
        leaves.select(F.inline(cells), *by, weight)
        .groupBy("_lvl", "_cell", *by)
        .agg(F.sum(weight).alias(weight))
        .withColumn("_whole", F.lit(True))
    )
    return items.unionByName(totals, allowMissingColumns=True)
