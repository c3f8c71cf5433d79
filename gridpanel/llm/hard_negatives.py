"""Hard negatives of anchors, from exact integer scores by Kronecker-packed products.

Components are whole numbers. Those of a candidate are made positive by adding `beta`, and several
candidates' are put side by side into fields of one wide integer, `width` bits each; an anchor's are
made positive by `alpha`. One multiplication by an anchor's component serves all fields, and
as no field's sum reaches its width, the sum over the components holds every candidate's sum
apart:  sum((c + beta) * (a + alpha)) = score + alpha * sum(c) + beta * sum(a) + dims * alpha * beta.
Unpacked and less the last three, the score is exact. Integers are kept in 53 bits of a double,
which linear algebra multiplies exactly, and in Python's integers where one field needs more.

Work. Rows are dealt into blocks of about BLOCK and anchors into groups of about GROUP; every pair
of a block and a group is one small task of its own (an equi-join on its number), so no task holds more than one block and one
group, whatever a label or a vector's copies hold. A first pass finds each anchor's positives, a second one the
negatives below each of them; a tile gives the few best per anchor, and these are ranked again.
As every anchor meets every row, work grows with anchors times rows.

Defined results: rows without an id, label or vector, or with a component that is null or not
finite, take no part, nor do rows whose components are so large that a score might not fit 64 bits; missing components of
shorter vectors count as 0; rows with an anchor's own id are never its candidates; equal scores and ids are
equal answers; an anchor repeated whole is one anchor; an anchor without positives, or a positive
without negatives in its range, gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridpanel.llm.scratch import materialise

BLOCK = 4096
GROUP = 2048
#: Bits of whole numbers that a double holds exactly.
MANTISSA = 53
#: What the tasks of a pass exchange.
_FOUND = "anchor bigint, place int, anchor_id bigint, found_id bigint, score bigint, positive_id bigint, positive_score bigint"


@dataclass
class Fields:
    """How candidates share an integer: biases, bits of a field, fields of an integer."""

    dims: int
    alpha: int
    beta: int

    @property
    def width(self) -> int:
        return max(1, (self.dims * 2 * self.alpha * 2 * self.beta).bit_length())

    @property
    def count(self) -> int:
        return MANTISSA // self.width if self.width <= MANTISSA else 8

    @property
    def kind(self) -> type:
        """Doubles if a whole integer fits their mantissa, else Python's integers."""
        return np.float64 if self.width <= MANTISSA else object

    def packed(self, rows: np.ndarray) -> np.ndarray:
        """(integers, dims): candidate i + k * len of (rows, dims) in field k of integer i."""
        n = -(-len(rows) // self.count)
        words = np.zeros((n, self.dims), dtype=object if self.kind is object else np.int64)
        for k in range(self.count):
            some = rows[k * n : (k + 1) * n]
            words[: len(some)] += (some + self.beta).astype(words.dtype) << (k * self.width)
        return words.astype(self.kind)

    def unpacked(self, sums: np.ndarray, n: int) -> np.ndarray:
        """(n, anchors) from the packed sums."""
        whole = sums if self.kind is object else sums.astype(np.int64)
        mask = (1 << self.width) - 1
        return np.concatenate([(whole >> (k * self.width)) & mask for k in range(self.count)])[:n]

    def scores(self, rows: np.ndarray, anchors: np.ndarray) -> np.ndarray:
        """(rows, anchors) inner products, exact."""
        kind = np.int64 if self.kind is np.float64 else object
        rows, anchors = rows.astype(kind), anchors.astype(kind)
        sums = self.packed(rows) @ (anchors + self.alpha).astype(self.kind).T
        biased = self.unpacked(sums, len(rows))
        extra = self.alpha * rows.sum(axis=1)[:, None] + self.beta * anchors.sum(axis=1)[None, :]
        return (biased - extra - self.dims * self.alpha * self.beta).astype(np.int64)


def quantised(rows: DataFrame, column: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, label, vector): floor(scale * x) of the rows that take part."""
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col(column).isNotNull() & finite).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("label").cast("long").alias("label"),
        F.transform(column, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))).alias("vector"),
    )


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    lists = column.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lists), dims), np.int64)
    values = lists.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(lists)), lengths)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _by_id(rows: pa.Table) -> pa.Table:
    """Candidates by id, so that a stable sort by score leaves ties in order of ids."""
    return rows.take(pa.array(np.argsort(_numbers(rows, "vec_id"), kind="stable")))


def _best(scores: np.ndarray, most: int) -> np.ndarray:
    """Places of the `most` greatest, ties by place."""
    if len(scores) > most:
        least = np.partition(scores, len(scores) - most)[len(scores) - most]
        among = np.flatnonzero(scores >= least)
        return among[np.argsort(-scores[among], kind="stable")[:most]]
    return np.argsort(-scores, kind="stable")


def _table(rows: list[tuple]) -> pa.Table:
    names = [part.split()[0] for part in _FOUND.split(", ")]
    kinds = [pa.int32() if " int" in part else pa.int64() for part in _FOUND.split(", ")]
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.table([pa.array(c, type=k) for c, k in zip(columns, kinds)], names=names)


def _tile(rows: pa.Table, anchors: pa.Table, fields: Fields) -> Iterator[tuple]:
    """(anchor's row, ids, labels, scores) of every anchor against one block."""
    rows = _by_id(rows)
    ids, labels = _numbers(rows, "vec_id"), _numbers(rows, "label")
    scores = fields.scores(_matrix(rows.column("vector"), fields.dims), _matrix(anchors.column("vector"), fields.dims))
    keys = anchors.drop_columns("vector").to_pylist()
    for at, key in enumerate(keys):
        yield key, ids, labels, scores[:, at]


def _positives(fields: Fields, most: int):
    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out = []
        if len(rows) and len(anchors):
            for key, ids, labels, scores in _tile(rows, anchors, fields):
                same = np.flatnonzero((labels == key["label"]) & (ids != key["vec_id"]))
                for at in same[_best(scores[same], most)]:
                    out.append((key["anchor"], 0, key["vec_id"], int(ids[at]), int(scores[at]), None, None))
        return _table(out)

    return run


def _negatives(fields: Fields, most: int, low: int):
    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out = []
        if len(rows) and len(anchors):
            for key, ids, labels, scores in _tile(rows, anchors, fields):
                top = max(p["score"] for p in key["positives"])
                other = np.flatnonzero((labels != key["label"]) & (ids != key["vec_id"]) & (scores <= top))
                for p in key["positives"]:
                    bound = -(-low * p["score"] // 100)  # the least whole score in the range
                    within = other[(scores[other] <= p["score"]) & (scores[other] >= bound)]
                    for at in within[_best(scores[within], most)]:
                        out.append(
                            (key["anchor"], p["place"], key["vec_id"], int(ids[at]), int(scores[at]), p["found_id"], p["score"])
                        )
        return _table(out)

    return run


def _ranked(found: DataFrame, most: int) -> DataFrame:
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "found_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def _dealt(rows: DataFrame, key: str, parts: int, other: str, others: int) -> DataFrame:
    """A part for each row by its number, and one copy for each part of the other side."""
    return rows.withColumn(key, F.pmod(F.xxhash64("number"), F.lit(parts))).withColumn(
        other, F.explode(F.sequence(F.lit(0), F.lit(others - 1)))
    )


def mine(
    vectors: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 5,
    low: int = 80,
    block: int = BLOCK,
    group: int = GROUP,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from whole-number vectors.

    An anchor's positives are its best rows of the same label; a positive's negatives are the best rows of other labels
    that score at least `low` hundredths of the positive's score and at most that score.
    """
    dims = F.max(F.size("vector"))
    largest = F.coalesce(F.array_max(F.transform("vector", lambda x: F.abs(x.cast("double")))), F.lit(0.0))
    held = materialise(vectors.withColumns({"number": F.monotonically_increasing_id(), "largest": largest}), "vectors")
    n_dims = max(held.agg(dims).first()[0] or 0, 1)
    fits = held.where(F.col("largest").between(0, math.isqrt((2**63 - 1) // n_dims)))
    size = fits.agg(F.count("*"), F.max("largest"), F.count(F.when(is_anchor, 1)), F.max(F.when(is_anchor, F.col("largest")))).first()
    fields = Fields(n_dims, max(int(size[3] or 0), 1), max(int(size[1] or 0), 1))
    blocks, groups = max(1, -(-size[0] // block)), max(1, -(-size[2] // group))

    rows = _dealt(fits.select("number", "vec_id", "label", "vector"), "block", blocks, "group", groups)
    rows = rows.select("block", "group", "vec_id", "label", "vector")
    anchors = fits.where(is_anchor).groupBy("vec_id", "label", "vector").agg(F.min("number").alias("number"))
    anchors = materialise(anchors, "anchors")

    def scored(some: DataFrame, function) -> DataFrame:
        some = _dealt(some, "group", groups, "block", blocks).withColumnRenamed("number", "anchor")
        keys = [F.col("block").cast("int"), F.col("group").cast("int")]
        return rows.groupBy(*keys).cogroup(some.drop("of").groupBy(*keys)).applyInArrow(function, _FOUND)

    first = _ranked(scored(anchors, _positives(fields, positives)), positives)
    first = first.groupBy(F.col("anchor").alias("of")).agg(
        F.collect_list(F.struct(F.col("rank").alias("place"), "found_id", "score")).alias("positives")
    )
    first = materialise(first, "positives")
    with_positives = anchors.join(first, F.col("number") == F.col("of"))
    last = _ranked(scored(with_positives, _negatives(fields, negatives, low)), negatives)
    return last.select(
        "anchor_id",
        "positive_id",
        "rank",
        F.col("found_id").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )
