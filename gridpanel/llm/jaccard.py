"""Exact Jaccard join of documents on five-word shingles, by pivots in a metric space.

Documents link when 100 * |x & y| >= 75 * |x | y|, that is when their Jaccard distance, a
metric, is at most EPSILON = 0.25. The result is the connected components of these links.

Regions. Between unrelated texts every distance is 1, so a Voronoi diagram of a few pivots over
all documents would replicate everything everywhere (2 * EPSILON reaches 1 from 0.5 on). Space is
therefore first cut by necessary shingles: under any order of all shingles, two linked
documents share one of the first |x| - ceil(0.75 |x|) + 1 of each. Shingles that three texts of some lot
hold are counted, and the order puts the rarer ones first in five steps, so that common passages rarely decide. A region is the
set of documents that share such a shingle with its first pivot: the set with the fewest rare shingles,
which in a group of copies is one with few changes of its own, near the middle of the group.

Leads. Two linked documents are left to the region of the first shingle they share. What stands before it in the order
is not shared, so a document's place of its first region shingle bounds the size of any intersection from above: its
`lead`. Sets that link share 3/7 of their sizes together, 6/7 of the smaller one, so that shingle lies in the first seventh of the
smaller set: shingles that lie there in no document lead to no region, and are told when they are counted. A member stays in a region only while another component has a member there whose size and lead allow a link;
these are told by the least size and the greatest lead in each of BANDS bands of sizes per doubling, some
thousand bands at most.

Join. In every region a pivot is compared with all members that no link has joined to it yet.
Members within EPSILON join the pivot's component. Then the triangle inequality is a window: a
member y of the pivot p's component can only link with an x outside of it if
d(x, p) <= d(y, p) + EPSILON, so y leaves the region if no such x is in it, and is kept as a
boundary document otherwise. The pivot leaves in any case; what is left, as long as it holds
two components, is joined again with new pivots, from its smallest components first and twice
as many at each level. No pair is ever compared within a component, so a group of near copies costs about
one comparison per member, and every pair that could be a link either is compared, is excluded
by the triangle inequality or by sizes, or lies within one component.

Before sets are compared, pairs are tested by sketches: a set's shingles are dealt into parts by their hash,
two or more parts to a shingle, and one bit tells whether a part holds an odd number of them. A
shingle added or removed turns one bit, so the number of bits that differ bounds the symmetric difference from below.

Equal sets are one class from the start, and one row of each class takes part: what copies share only with each other is
never shuffled, as a filter of these rows tells before (the few copies that it lets through change nothing). Sets are 64-bit hashes. Only the sets of pairs that pass the
bounds are computed again and written, from one document of each class; a Bloom
filter of fixed size names these documents.

Defined results: a null or empty text has no shingles and is alone; fewer than five words are
one shingle; rows that repeat a doc_id are rows of their own, and links lead through
all of them; a component's id is its least doc_id that is not null; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridpanel.llm import bloom, text
from gridpanel.llm.components import components
from gridpanel.llm.scratch import beside, delete, free_name, materialise
from gridpanel.session import arrow_batches

SHINGLE = 5
EPSILON = 0.25
#: Bits of the longest sketch, as a power of 2.
LOG2_SKETCH = 15
BANDS = 64
#: Tokens passed on at once.
LOT = 1 << 20
#: Size of the batches of texts and sets that Python gets.
BATCH_BYTES = "4m"
#: Occurrences that make a shingle commoner by one step; what COMMON texts of a lot hold is counted.
STEPS = (3, 12, 48, 192, 768)
COMMON = STEPS[0]
#: What a shingle in the first seventh of a set counts besides 1: more than there are sets.
INNER = 1 << 32
LOG2_BITS = 24
#: Bits of the largest filter, 32 MB, as a power of 2.
MOST_BITS = 28


def _sets(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingles) of every text."""
    everything, offsets = text.column_bytes(column)
    for lo, hi in text.groups_of_texts(offsets, 1 << 20):
        data = everything[offsets[lo] : offsets[hi]]
        words = text.words(data, offsets[lo : hi + 1] - offsets[lo], text.SPACED)
        every = text.shingles(words.hash, SHINGLE)
        for i in range(hi - lo):
            a, b = int(words.first[i]), int(words.first[i + 1])
            if b - a < SHINGLE:
                yield lo + i, text.shingle_set(words.hash[a:b], SHINGLE)
                continue
            found = np.sort(every[a : b - SHINGLE + 1])
            keep = np.empty(len(found), dtype=bool)
            keep[0] = True
            np.not_equal(found[1:], found[:-1], out=keep[1:])
            yield lo + i, found[keep]


def _prefix(shingles: np.ndarray, common: list[bloom.Bloom]) -> tuple[np.ndarray, int]:
    """The necessary shingles of a set in the order (how common, hash), and how many of all are rare."""
    n = len(shingles)
    length = n - -(-3 * n // 4) + 1 if n else 0
    step = np.zeros(n, np.int8)
    for filter_ in common:
        step += filter_.holds(shingles)
    return shingles[np.argsort(step, kind="stable")[:length]], int((step == 0).sum())


def _longs(hashes: np.ndarray) -> pa.Array:
    return pa.array(hashes.view(np.int64))


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles that COMMON texts of a lot hold; lots do not end with batches."""
    kept, size = [], 0
    for batch in batches:
        for _, found in _sets(batch.column(0)):
            kept.append(found)
            size += len(found)
            if size > 1 << 21:
                yield _counted(kept)
                kept, size = [], 0
    if kept:
        yield _counted(kept)


def _counted(sets: list[np.ndarray]) -> pa.RecordBatch:
    found = np.concatenate(sets)
    found.sort()
    # Only what comes often enough gets a count, so that no count of every shingle is held.
    again = np.unique(found[: 1 - COMMON][found[COMMON - 1 :] == found[: 1 - COMMON]])
    counts = np.searchsorted(found, again, "right") - np.searchsorted(found, again, "left")
    return pa.RecordBatch.from_arrays([_longs(again), pa.array(counts.astype(np.int64))], names=["h", "n"])


def _class(shingles: np.ndarray) -> int:
    """A hash of the set; sets are sorted."""
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes())).view(np.int64))


def _sketch(shingles: np.ndarray) -> np.ndarray:
    """One bit for each part of the hashes: whether it holds an odd number of shingles; 64 bits to a number."""
    bits = 1 << min(max((2 * len(shingles)).bit_length(), 8), LOG2_SKETCH)
    part = (shingles & np.uint64(bits - 1)).astype(np.int64)
    odd = (np.bincount(part, minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64)


def _documents(common: list[bloom.Bloom]):
    """(doc_id, class, n, rare, tokens, sketch): tokens are the necessary shingles in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (lot for whole in batches for lot in text.lots(whole, 1)):
            classes, sizes, rares, tokens, sketches = [], [], [], [], []
            for _, found in _sets(batch.column(1)):
                prefix, rare = _prefix(found, common)
                classes.append(_class(found))
                sizes.append(len(found))
                rares.append(rare)
                tokens.append(prefix)
                sketches.append(_sketch(found))
            flat = np.concatenate([np.zeros(0, np.uint64), *tokens]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(classes, pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array(rares, pa.int64()),
                    text.nested(flat, [len(t) for t in tokens], pa.int64()),
                    text.nested(np.concatenate([np.zeros(0, np.int64), *sketches]), [len(k) for k in sketches], pa.int64()),
                ],
                names=["doc_id", "class", "n", "rare", "tokens", "sketch"],
            )

    return run


def _holding(batch: pa.RecordBatch, filters: dict[str, bloom.Bloom]) -> pa.RecordBatch:
    """Rows whose keys, by the names of their columns, the filters hold."""
    for column, filter_ in filters.items():
        keys = batch.column(column).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        batch = batch.filter(pa.array(filter_.holds(keys)))
    return batch


def _tokens(firsts: bloom.Bloom):
    """(h, n): tokens of the first row of each class, from (n, tokens, key); n counts 1, and INNER more in the first seventh."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (_holding(whole, {"key": firsts}) for whole in batches):
            n = batch.column("n").to_numpy(zero_copy_only=False)
            lengths = batch.column("tokens").value_lengths().to_numpy(zero_copy_only=False)
            place = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            inner = 7 * place <= np.repeat(n, lengths)
            yield pa.RecordBatch.from_arrays([batch.column("tokens").flatten(), pa.array(1 + INNER * inner)], names=["h", "n"])

    return run


def _shared_tokens(firsts: bloom.Bloom, shared: bloom.Bloom):
    """(h, node, n, rare, lead) of tokens that another class may have, too, from (class, n, rare, tokens, key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (_holding(whole, {"key": firsts}) for whole in batches):
            lengths = batch.column(3).value_lengths().to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(lengths)])
            hashes = batch.column(3).flatten().to_numpy(zero_copy_only=False)
            node, n, rare = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            for lo, hi in text.groups_of_texts(ends, LOT):
                found = hashes[ends[lo] : ends[hi]]
                held = np.flatnonzero(shared.holds(found.view(np.uint64)))
                row = np.repeat(np.arange(lo, hi), lengths[lo:hi])[held]
                lead = n[row] - (held + ends[lo] - ends[row])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c) for c in (found[held], node[row], n[row], rare[row], lead)],
                    names=["h", "node", "n", "rare", "lead"],
                )

    return run


def _needed_sets(needed: bloom.Bloom):
    """(class, shingles) of documents whose key the filter holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            rows = np.flatnonzero(needed.holds(keys))
            for lot in text.lots(batch.take(pa.array(rows)), 1):
                sets = [found for _, found in _sets(lot.column(1))]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([_class(s) for s in sets], pa.int64()),
                        text.nested(np.concatenate(sets).view(np.int64), [len(s) for s in sets], pa.int64()),
                    ],
                    names=["class", "shingles"],
                )

    return run


#: Linked sets of n and m shingles share 3/7 of n + m at least.
_LINKABLE = "7 * least({lead}, {other_lead}) >= 3 * ({n} + {other_n})"


def _regions(tokens: DataFrame) -> DataFrame:
    """(region, node, n, rare, lead): documents that share a necessary shingle, by its first pivot."""
    # Copies are rows of one node, so that a shingle is shared where two nodes hold it.
    first = tokens.groupBy("h").agg(
        F.min(F.struct("rare", "n", "node")).alias("first"),
        F.min("node").alias("lo"),
        F.max("node").alias("hi"),
        F.min("n").alias("least_n"),
        F.max("lead").alias("most_lead"),
    )
    first = first.where("lo != hi").select("h", F.col("first.node").alias("region"), "least_n", "most_lead")
    first = materialise(first, "regions")
    # A partner has three quarters of the size at least.
    linkable = _LINKABLE.format(lead="lead", other_lead="most_lead", n="n", other_n="greatest(least_n, 0.75 * n)")
    found = tokens.join(first, "h").where(linkable)
    return found.groupBy("region", "node", "n", "rare").agg(F.max("lead").alias("lead"))


def _linkable(members: DataFrame) -> DataFrame:
    """Members that may link with one of another component of their region, as far as sizes and leads tell."""
    bands = members.groupBy("region", F.floor(BANDS * F.log2("n")).alias("band")).agg(
        F.min("n").alias("other_n"), F.max("lead").alias("other_lead"), F.min("comp").alias("lo"), F.max("comp").alias("hi")
    )
    regions = bands.groupBy("region").agg(
        F.collect_list(F.struct("other_n", "other_lead", "lo", "hi")).alias("bands"),
        F.min("lo").alias("lo"),
        F.max("hi").alias("hi"),
    )
    regions = materialise(regions.where("lo != hi").select("region", "bands"), "active")
    linkable = _LINKABLE.format(lead="lead", other_lead="s.other_lead", n="n", other_n="s.other_n")
    other = f"exists(bands, s -> (s.lo != comp or s.hi != comp) and {linkable})"
    return members.join(regions, "region").where(other).drop("bands")


def _pivots(known: DataFrame, wanted: int) -> DataFrame:
    """(region, pivot, pivot_n, pivot_lead, pivot_comp): `wanted` members of each region, those of small components first."""
    sizes = materialise(known.groupBy("region", "comp").agg(F.count("*").alias("size")), "sizes")
    order = Window.partitionBy("region").orderBy("size", "rare", "n", "node")
    return (
        known.join(sizes, ["region", "comp"])
        .withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= wanted)
        .withColumnsRenamed({"node": "pivot", "n": "pivot_n", "lead": "pivot_lead", "comp": "pivot_comp"})
        .select("region", "pivot", "pivot_n", "pivot_lead", "pivot_comp")
    )


def _faced(known: DataFrame, pivots: DataFrame) -> DataFrame:
    """(region, pivot, node, a, b, n_a, n_b, low, linkable): members of other components than the pivot's.

    (a, b) is the pair in order, `low` a lower bound of its distance from the sizes; leads do not bound the distance,
    but a pair that is not `linkable` by them is no link, or one of another region.
    """
    first = F.col("pivot") < F.col("node")
    return known.join(pivots, "region").where("comp != pivot_comp").select(
        "region",
        "pivot",
        "node",
        F.least("pivot", "node").alias("a"),
        F.greatest("pivot", "node").alias("b"),
        F.when(first, F.col("pivot_n")).otherwise(F.col("n")).alias("n_a"),
        F.when(first, F.col("n")).otherwise(F.col("pivot_n")).alias("n_b"),
        (1 - F.least("n", "pivot_n") / F.greatest("n", "pivot_n")).alias("low"),
        F.expr(_LINKABLE.format(lead="lead", other_lead="pivot_lead", n="n", other_n="pivot_n")).alias("linkable"),
    )


def _wide(n: int, log2_bits: int) -> int:
    """Bits of a filter of n keys, as a power of 2: sixteen a key keep most others out, up to MOST_BITS."""
    return min(max(log2_bits, (16 * n).bit_length()), MOST_BITS)


def _held(table: DataFrame, filters: dict[str, bloom.Bloom]) -> DataFrame:
    """Rows that the filters hold, told before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _holding(batch, filters)

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.schema)
    return table.mapInArrow(run, fields)


def _needed(table: DataFrame, column: str, pairs: DataFrame, log2_bits: int) -> DataFrame:
    """Rows whose `column` is an end of a pair (a, b), and few others."""
    ends = pairs.select(F.col("a").alias("end")).union(pairs.select("b")).distinct()
    return _held(table, {column: bloom.build(ends, "end", log2_bits)})


def _firsts(base: DataFrame, log2_bits: int) -> bloom.Bloom:
    """A filter of the keys of one row of each class, of the least doc_id where there is one."""
    # Only numbers of rows are shuffled; a key is a hash of the number.
    row = F.coalesce(F.min_by("row", "doc_id"), F.min("row"))
    rows = materialise(base.groupBy("class").agg(row.alias("row")).select(F.xxhash64("row").alias("key")), "firsts")
    firsts = bloom.build(rows, "key", _wide(rows.count(), log2_bits))
    delete(rows)
    return firsts


def _bounded(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """(a, b, total, differ) of pairs (a, b, n_a, n_b): sizes together, and how much the sets differ at least."""
    a_sketch = sketches.select(F.col("node").alias("a"), F.col("sketch").alias("a_sketch"))
    b_sketch = sketches.select(F.col("node").alias("b"), F.col("sketch").alias("b_sketch"))
    joined = pairs.join(b_sketch, "b").join(a_sketch, "a")

    def as_short(name: str, other: str) -> Column:
        """A sketch as long as the other one: sizes of a pair allow for one halving, which adds the halves' bits."""
        half = F.size(name) / 2
        halves = [F.slice(name, start, half.cast("int")) for start in (F.lit(1), (half + 1).cast("int"))]
        halved = F.zip_with(*halves, lambda x, y: x.bitwiseXOR(y))
        return F.when(F.size(name) > F.size(other), halved).otherwise(F.col(name))

    turned = F.zip_with(
        as_short("a_sketch", "b_sketch"), as_short("b_sketch", "a_sketch"), lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("long")
    )
    differ = F.aggregate(turned, F.lit(0).cast("long"), lambda s, x: s + x)
    return joined.select("a", "b", (F.col("n_a") + F.col("n_b")).alias("total"), differ.alias("differ"))


#: Linked pairs differ in a seventh of their sizes together at most.
_NEAR = "total >= 7 * differ"


def _far(bounded: DataFrame) -> DataFrame:
    """(a, b, d, exact, linked) of pairs that the sketches exclude; d is a lower bound."""
    most = (F.col("total") - F.col("differ")) / 2
    lower = 1 - most / (F.col("total") - most)
    return bounded.where(f"not {_NEAR}").select(
        "a", "b", lower.alias("d"), F.lit(False).alias("exact"), F.lit(False).alias("linked")
    )


def _measured(near: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, d, exact, linked) from the sets themselves."""
    a_sets = sets.select(F.col("class").alias("a"), F.col("shingles").alias("a_set"))
    b_sets = sets.select(F.col("class").alias("b"), F.col("shingles").alias("b_set"))
    both = F.size(F.array_intersect("a_set", "b_set")).cast("long")
    union = F.col("total") - F.col("both")
    return (
        near.join(b_sets, "b")
        .join(a_sets, "a")
        .select("a", "b", "total", both.alias("both"))
        .distinct()
        .select(
            "a",
            "b",
            (1 - F.col("both") / union).alias("d"),
            F.lit(True).alias("exact"),
            (100 * F.col("both") >= 75 * union).alias("linked"),
        )
    )


def _labelled(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    members = members.select("region", "node", "n", "rare", "lead")
    if labels is None:
        return members.withColumn("comp", F.col("node"))
    return members.join(labels, "node", "left").select(*members.columns, F.coalesce("comp", "node").alias("comp"))


def _left(known: DataFrame, pivots: DataFrame, faced: DataFrame, tested: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Members that may still link with another component of their region."""
    now = lambda name: labels.select(F.col("node").alias(name), F.col("comp").alias(f"{name}_now"))
    rows = faced.join(tested.select("a", "b", "d", "exact"), ["a", "b"], "left").select(
        "region",
        "pivot",
        "node",
        F.coalesce("d", "low").alias("d"),
        F.coalesce("exact", F.lit(False)).alias("exact"),
    )
    if labels is not None:
        rows = rows.join(now("pivot"), "pivot", "left").join(now("node"), "node", "left")
        same = F.coalesce("pivot_now", "pivot") == F.coalesce("node_now", "node")
    else:
        same = F.lit(False)
    rows = materialise(rows.withColumn("same", same).select("region", "pivot", "node", "d", "exact", "same"), "windows")
    # One row for each pivot that still faces others: small beside the members it is joined with.
    nearest = materialise(rows.where("not same").groupBy("region", "pivot").agg(F.min("d").alias("nearest")), "nearest")
    gone = (
        rows.where("same and exact")
        .join(nearest, ["region", "pivot"], "left")
        # Beyond the window no document of another component can be within EPSILON; the margin is for rounding.
        .where(F.col("nearest").isNull() | (F.col("d") + EPSILON + 1e-9 < F.col("nearest")))
        .select("region", "node")
        .union(pivots.select("region", F.col("pivot")))
        .distinct()
    )
    gone = materialise(gone, "gone")
    left = materialise(known.drop("comp").join(gone, ["region", "node"], "left_anti"), "members")
    delete(rows, gone, nearest)
    return left


def links(docs: DataFrame, log2_bits: int = LOG2_BITS) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, class, n, ...) and labels (node, comp) of classes that link with others, or None."""
    with arrow_batches(docs.sparkSession, BATCH_BYTES):
        return _links(docs, log2_bits)


def _links(docs: DataFrame, log2_bits: int) -> tuple[DataFrame, DataFrame]:
    counted = docs.select("text").mapInArrow(_common, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))
    counted = materialise(counted, "common")
    common = [bloom.build(counted.where(F.col("n") >= least), "h", log2_bits) for least in STEPS]
    kind = docs.schema["doc_id"].dataType.simpleString()
    base = materialise(
        docs.select("doc_id", "text").mapInArrow(
            _documents(common), f"doc_id {kind}, class bigint, n bigint, rare bigint, tokens array<bigint>, sketch array<bigint>"
        ).withColumn("row", F.monotonically_increasing_id()),
        "documents",
    )
    delete(counted)
    firsts, key = _firsts(base, log2_bits), F.xxhash64("row").alias("key")
    rows = base.select("n", "tokens", key).mapInArrow(_tokens(firsts), "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))
    held = materialise(rows.where(f"n > {INNER} + 1").select("h"), "shared")
    # A fuller filter lets more rows into the regions' shuffles.
    shared = bloom.build(held, "h", _wide(held.count(), log2_bits))
    delete(held)
    tokens = base.select("class", "n", "rare", "tokens", key).mapInArrow(
        _shared_tokens(firsts, shared), "h bigint, node bigint, n bigint, rare bigint, lead bigint"
    )
    tokens = materialise(tokens, "tokens")
    members = materialise(_regions(tokens), "members")
    delete(tokens)
    nodes = materialise(members.select("node").distinct(), "nodes")
    filters = {"node": bloom.build(nodes, "node", _wide(nodes.count(), log2_bits)), "key": firsts}
    leaders = materialise(
        _held(base.select(F.col("class").alias("node"), "doc_id", "sketch", key), filters)
        .groupBy("node")
        .agg(F.min("doc_id").alias("doc_id"), F.any_value("sketch").alias("sketch"))
        .join(nodes, "node", "left_semi"),
        "leaders",
    )
    delete(nodes)
    labels, sets, tested, level = None, None, None, 0
    while True:
        known = materialise(_linkable(_labelled(members, labels)), "known")
        if known.isEmpty():
            break
        delete(members)
        pivots = materialise(_pivots(known, 4 << level if level else 1), "pivots")
        faced = materialise(_faced(known, pivots), "faced")
        pairs = faced.where((F.col("low") <= EPSILON) & F.col("linkable")).select("a", "b", "n_a", "n_b").distinct()
        if tested is not None:
            pairs = pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti")
        pairs = materialise(pairs, "pairs")
        bounded = materialise(_bounded(pairs, _needed(leaders, "node", pairs, log2_bits)), "bounded")
        delete(pairs)
        near = bounded.where(_NEAR)
        sets = _with_sets(docs, near, leaders, sets, log2_bits)
        measured = _far(bounded)
        if sets is not None:
            measured = measured.union(_measured(near, _needed(sets, "class", near, log2_bits)))
        measured = materialise(measured, "measured")
        delete(bounded)
        tested = measured if tested is None else tested.union(measured)
        edges = measured.where("linked").select("a", "b")
        if not edges.isEmpty():
            labels = components(edges, labels)
        members = _left(known, pivots, faced, tested, labels)
        delete(known, pivots, faced)
        level += 1
    if sets is not None:
        delete(sets)
    return base, labels


def _with_sets(
    docs: DataFrame, near: DataFrame, leaders: DataFrame, sets: DataFrame | None, log2_bits: int
) -> DataFrame | None:
    """(class, shingles) for both ends of all pairs: the sets so far, and those that are new."""
    ends = near.select(F.col("a").alias("node")).union(near.select("b")).distinct()
    if sets is not None:
        ends = ends.join(sets.select(F.col("class").alias("node")), "node", "left_anti")
    key = F.xxhash64("doc_id")
    wanted = materialise(leaders.join(ends, "node", "left_semi").select(key.alias("key")), "wanted")
    if wanted.isEmpty():
        return sets
    needed = bloom.build(wanted, "key", log2_bits)
    # A class comes once for each row with its leader's doc_id; what the filter lets through besides joins nothing.
    found = materialise(
        docs.select(key.alias("key"), "text").mapInArrow(
            _needed_sets(needed), "class bigint, shingles array<bigint>"
        ),
        "sets",
    )
    return found if sets is None else sets.union(found)


def classes(docs: DataFrame, log2_bits: int = LOG2_BITS) -> DataFrame:
    """One row per document: doc_id, n_shingles and component_id, the least doc_id that links lead to."""
    base, labels = links(docs, log2_bits)
    of_class = base.groupBy("class").agg(F.min("doc_id").alias("least"))
    if labels is None:
        joined = of_class.withColumn("comp", F.col("class"))
    else:
        joined = of_class.join(labels.withColumnRenamed("node", "class"), "class", "left").select(
            "class", "least", F.coalesce("comp", "class").alias("comp")
        )
    joined = materialise(joined, "classes")
    least = materialise(joined.groupBy("comp").agg(F.min("least").alias("component_id")), "least")
    resolved = materialise(joined.join(least, "comp").select("class", "component_id"), "resolved")
    return (
        base.select("doc_id", "class", "n")
        .join(resolved, "class")
        .select(
            "doc_id",
            F.col("n").alias("n_shingles"),
            F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        )
    )


def representatives(docs: DataFrame) -> DataFrame:
    """One row of each component with all its columns: the least doc_id, null last, and the first row of it.

    Rows are told apart by a number, so rows that share a doc_id, or have none, stay or leave one by one.
    """
    row, first = free_name(docs, "row_number"), free_name(docs, "row_stays")
    held = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    key = F.struct(F.col("doc_id").isNull().alias("missing"), F.col("doc_id").alias("id"), F.col(row).alias("row"))
    found = classes(held.select(key.alias("doc_id"), "text"))
    found = found.select(F.col("doc_id.row").alias(row), (F.col("doc_id") == F.col("component_id")).alias(first))
    return beside(held, row, found, first).where(F.col(first)).drop(row, first)
