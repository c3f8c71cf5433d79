"""Merkle manifest of a table: roots and inclusion proofs by time-forward processing.

Leaves of one tree are numbered from 0. While a tree has several nodes, every ARITY consecutive ones become one, the
digest of theirs, also where the last run is shorter. A node's label is (level, number); a parent's label is
greater than its children's. Going up, nodes are met in the order of their labels, and each sends its digest forward
to its parent through a priority queue, which hands a parent all its children's digests in order when
its turn comes. Going down, labels are met in reverse, and each parent sends the part of the proof
above it to its children, until the leaves have their whole proofs.

The queue is external in two steps. Spark's shuffle delivers digests to pieces, subtrees of LEVELS levels
(at most ARITY ** LEVELS nodes), and a heap orders labels within a piece. Trees are as deep as
their pieces: a hundred million leaves need three rounds, and a tree that holds a third of all rows is as many tasks
as it has pieces. Numbers of leaves come from a sort by ranges whose counts are added up; no window spans a tree.

Every source is a tree; the roots of the sources, in order, are the leaves of one more tree.

Defined results: a null field is `-`; equal rows are leaves of their own, with equal digests; rows that share a source
and doc_id follow by digest, a null doc_id comes first; an empty table has no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridpanel.llm.scratch import materialise

ARITY = 3
LEVELS = 6
PIECE = ARITY**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_STEPS = "array<struct<before: string, after: string>>"
_STEPS_ARROW = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))


def digest_of(fields: list[Column]) -> Column:
    """Of all fields, each `-` if null, else its bytes' count, a colon and the value."""
    parts = []
    for field in fields:
        value = field.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def leaf_digest(text: Column | None = None) -> Column:
    """Of a row of documents, or of one with another text."""
    return digest_of([text if name == "text" and text is not None else F.col(name) for name in FIELDS])


def numbered(rows: DataFrame, tree: Column, *order: Column) -> DataFrame:
    """`tree`, and `place`, from 0 in each tree by `order`; `size` is the tree's.

    Rows are sorted by ranges and written with their part and their place in it; the counts of
    (tree, part) give each part's first place.
    """
    sort = [F.col("tree").asc_nulls_first(), *order]
    kinds = rows.schema

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, at = None, -1
        for batch in batches:
            places = []
            for now in batch.column("tree").to_pylist():
                at = at + 1 if now == tree and at >= 0 else 0
                tree = now
                places.append(at)
            yield batch.append_column("in_part", pa.array(places, pa.int64()))

    named = rows.withColumn("tree", tree)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in named.schema)
    dealt = (
        named.repartitionByRange(*sort)
        .sortWithinPartitions(*sort)
        .withColumn("part", F.spark_partition_id())
        .mapInArrow(count, f"{fields}, part int, in_part bigint")
    )
    held = materialise(dealt, "numbered")
    counts = held.groupBy("tree", "part").agg(F.count("*").alias("n"))
    parts = Window.partitionBy("tree").orderBy("part")
    firsts = counts.select(
        F.struct("tree").alias("key"),
        F.col("part").alias("of_part"),
        (F.sum("n").over(parts) - F.col("n")).alias("first"),
        F.sum("n").over(Window.partitionBy("tree")).alias("size"),
    )
    firsts = materialise(firsts, "parts")
    same = (F.col("part") == F.col("of_part")) & F.col("tree").eqNullSafe(F.col("key.tree"))
    return held.join(firsts, same).select(
        *[c for c in kinds.names if c != "tree"], "tree", "size", (F.col("in_part") + F.col("first")).alias("place")
    )


def _digest(children: list[str]) -> str:
    return sha256("".join(children).encode()).hexdigest()


def _climbed(leaves: list[tuple[int, str]], levels: int | None) -> tuple[list[tuple[int, int, str]], dict]:
    """Labels and digests of the highest nodes, and the children's digests of every node below.

    `levels` to climb, or None: until one node is left.
    """
    queue = [(0, place, digest) for place, digest in leaves]
    heapq.heapify(queue)
    left = {0: len(queue)}
    children: dict[tuple[int, int], list[str]] = {}
    while queue:
        level = queue[0][0]
        if level == levels or levels is None and left[level] == 1:
            break
        # All children of the next parent are at the head of the queue, in order.
        parent = queue[0][1] // ARITY
        run = []
        while queue and queue[0][0] == level and queue[0][1] // ARITY == parent:
            run.append(heapq.heappop(queue)[2])
        children[level + 1, parent] = run
        left[level + 1] = left.get(level + 1, 0) + 1
        heapq.heappush(queue, (level + 1, parent, _digest(run)))
    return sorted(queue), children


def _levels(size: int) -> int | None:
    """A piece of a tree of more nodes goes up a fixed number of levels, the only piece to its root."""
    return LEVELS if size > PIECE else None


def _up(piece: pa.Table) -> pa.Table:
    """The highest node of a piece as a node of the next round."""
    size = piece.column("size")[0].as_py()
    nodes = list(zip(piece.column("place").to_pylist(), piece.column("digest").to_pylist()))
    (top,), _ = _climbed(nodes, _levels(size))
    return pa.table(
        [
            piece.column("tree").slice(0, 1),
            pa.array([-(-size // PIECE)], pa.int64()),
            pa.array([nodes[0][0] // PIECE], pa.int64()),
            pa.array([top[2]], pa.string()),
        ],
        names=["tree", "size", "place", "digest"],
    )


def _down(piece: pa.Table, above: pa.Table) -> pa.Table:
    """The proof of every node of a piece: its own part first, then that of the piece."""
    size = piece.column("size")[0].as_py()
    places = piece.column("place").to_pylist()
    tops, children = _climbed(list(zip(places, piece.column("digest").to_pylist())), _levels(size))
    suffix = above.column("steps")[0].as_py() if len(above) else []
    # Labels in reverse: a parent comes before its children and leaves its proof for them.
    queue = [(-level, -number) for level, number, _ in tops]
    proofs = {(level, number): suffix for level, number, _ in tops}
    out = {}
    while queue:
        level, number = (-x for x in heapq.heappop(queue))
        steps = proofs.pop((level, number))
        if level == 0:
            out[number] = steps
            continue
        run = children[level, number]
        # Places are those of the tree, so the first child of a run is a multiple of the arity.
        for i, _ in enumerate(run):
            child = (level - 1, number * ARITY + i)
            proofs[child] = [{"before": "".join(run[:i]), "after": "".join(run[i + 1 :])}, *steps]
            heapq.heappush(queue, (-child[0], -child[1]))
    return piece.append_column("steps", pa.array([out[p] for p in places], _STEPS_ARROW))


def _piece() -> Column:
    return F.floor(F.col("place") / PIECE).cast("long").alias("piece")


def climb(nodes: DataFrame) -> list[DataFrame]:
    """Nodes (tree, size, place, digest) of every round, from the given ones to the roots of all trees."""
    rounds = [nodes.select("tree", "size", "place", "digest")]
    kind = rounds[0].schema["tree"].dataType.simpleString()
    largest = nodes.agg(F.max("size")).first()[0] or 0
    while True:
        up = rounds[-1].groupBy("tree", _piece()).applyInArrow(
            _up, f"tree {kind}, size bigint, place bigint, digest string"
        )
        rounds.append(materialise(up, "nodes"))
        if largest <= PIECE:
            return rounds
        largest = -(-largest // PIECE)


def descend(nodes: DataFrame, rounds: list[DataFrame], above: DataFrame | None = None) -> DataFrame:
    """`nodes` with `steps`, their proofs; `above` (tree, steps) has what follows behind each tree's root."""
    kinds = lambda df: ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
    if above is None:
        steps = rounds[-1].select("tree", "place", F.array().cast(_STEPS).alias("steps"))
    else:
        steps = above.select("tree", F.lit(0).cast("long").alias("place"), "steps")
    for k, lower in reversed(list(enumerate([nodes, *rounds[1:-1]]))):
        lower = lower.withColumn("piece", _piece())
        upper = steps.select("tree", F.col("place").alias("piece"), "steps")
        down = lower.groupBy("tree", "piece").cogroup(upper.groupBy("tree", "piece")).applyInArrow(
            lambda piece, over: _down(piece, over) if len(piece) else _nothing(piece),
            f"{kinds(lower)}, steps {_STEPS}",
        )
        steps = down if k == 0 else materialise(down.select("tree", "place", "steps"), "proofs")
    return steps.drop("piece")


def _nothing(piece: pa.Table) -> pa.Table:
    return piece.append_column("steps", pa.array([], _STEPS_ARROW))


def proof_digest(steps: Column) -> Column:
    """Of the siblings' digests, level by level."""
    joined = F.transform(steps, lambda s: F.concat(s["before"], s["after"]))
    return F.sha2(F.array_join(joined, ""), 256)


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(steps, leaf, lambda digest, s: F.sha2(F.concat(s["before"], digest, s["after"]), 256))


def manifest(docs: DataFrame, tampered: Column) -> DataFrame:
    """(doc_id, source, leaf, changed, subroot, root, steps) of every row.

    `changed` is the leaf's digest with the text that the expression `tampered` gives; trees and proofs know nothing of it.
    """
    leaves = docs.select(
        "doc_id", "source", leaf_digest().alias("digest"), leaf_digest(tampered).alias("changed")
    )
    leaves = numbered(leaves, F.col("source"), F.col("doc_id").asc_nulls_first(), F.col("digest")).drop("source")
    rounds = climb(leaves)
    # One root for each source; these are the leaves of the last tree.
    subroots = rounds[-1].select(F.col("tree").alias("name"), "digest")
    top = numbered(subroots, F.lit(0), F.col("name").asc_nulls_first())
    top_rounds = climb(top)
    root = top_rounds[-1].first()
    over = descend(top, top_rounds).select("name", F.col("digest").alias("subroot"), "steps")
    over = materialise(over, "above")
    # Nodes take their own columns along, so what belongs to the source joins them before proofs make rows long.
    leaves = leaves.join(over.drop("steps"), F.col("tree").eqNullSafe(F.col("name"))).drop("name")
    proofs = descend(leaves, rounds, over.select(F.col("name").alias("tree"), "steps"))
    return proofs.select(
        "doc_id",
        F.col("tree").alias("source"),
        F.col("digest").alias("leaf"),
        "changed",
        "subroot",
        F.lit(root and root["digest"]).cast("string").alias("root"),
        "steps",
    )
