"""A uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Rows lie in 2**k partitions. Instead of letting each row draw its shard, which would make shard
sizes random, the matrix of how many rows each partition sends to each shard is drawn first: its
row sums are the partitions' sizes, its column sums the shards' sizes (equal up to one row), and
its law is the one that a uniform shuffle of all rows induces. Each partition then permutes its
rows and deals them out by its line of the matrix, the rows are exchanged, and each shard
permutes what it got. A shard is permuted in buckets of the second random key, whose sizes are
summed up first, so no task holds a whole shard.

The matrix is drawn by halving: a node knows the sizes of its partitions and what goes to each
shard from all of them; the left half's counts are a multivariate hypergeometric draw, shard by
shard, and the right half gets the rest. A hypergeometric number is found by inversion: weights
relative to the mode follow from the ratio of neighbouring terms, outward to where they no
longer matter (12 standard deviations), so no factorial is ever computed. Every level is one
narrow step, and beyond the sixth level the nodes are spread over tasks.

Randomness is a hash of the row (doc_id, size, crc) and a seed: reruns agree. Everything is
DataFrame functions.

Defined results: a null text has no bytes and no checksum; equal rows are dealt like any others
(in any order among themselves); a null doc_id is a value; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridpanel.llm.scratch import free_name, materialise

PART_ROWS = 1 << 16
LEAST_PARTS = 64
SPREAD_LEVEL = 6
SPREAD_TASKS = 256
BUCKET_ROWS = 1 << 14
LEAST_BUCKETS = 8


def _uniform(*key) -> Column:
    """In (0, 1), from a hash."""
    return (F.shiftrightunsigned(F.xxhash64(*key), 11).cast("double") + 0.5) / float(1 << 53)


def hypergeometric(total: Column, good: Column, drawn: Column, u: Column) -> Column:
    """How many of `good` among `total` rows are among `drawn`, at the quantile u (all longs, u a double)."""
    n, k, d = total.cast("double"), good.cast("double"), drawn.cast("double")
    low, high = F.greatest(F.lit(0.0), d + k - n), F.least(d, k)
    mode = F.least(F.greatest(F.floor((d + 1) * (k + 1) / (n + 2)).cast("double"), low), high)
    share = k / F.greatest(n, F.lit(1.0))
    spread = F.sqrt(d * share * (1 - share) * F.greatest(n - d, F.lit(0.0)) / F.greatest(n - 1, F.lit(1.0)))
    reach = F.ceil(12 * spread + 12)

    def outward(state: Column, step: Column, target: Column | None) -> Column:
        """Weights at mode + step and mode - step; without a target the state is their sum alone."""
        up, down = state["mode"] + step, state["mode"] - step
        above = F.when(
            up <= state["high"],
            state["above"] * (state["k"] - up + 1) * (state["d"] - up + 1) / (up * (state["n"] - state["k"] - state["d"] + up)),
        ).otherwise(0.0)
        below = F.when(
            down >= state["low"],
            state["below"]
            * (down + 1)
            * (state["n"] - state["k"] - state["d"] + down + 1)
            / ((state["k"] - down) * (state["d"] - down)),
        ).otherwise(0.0)
        fixed = [state[f].alias(f) for f in ("n", "k", "d", "low", "high", "mode", "reach")]
        if target is None:
            rest = [(state["sum"] + above + below).alias("sum")]
        else:
            left = state["left"]
            rest = [
                (left - above - below).alias("left"),
                F.when(state["found"] >= 0, state["found"])
                .when(left - above < 0, up)
                .when(left - above - below < 0, down)
                .otherwise(state["found"])
                .alias("found"),
            ]
        return F.struct(*fixed, above.alias("above"), below.alias("below"), *rest)

    one = F.lit(1.0)
    known = [x.alias(f) for x, f in ((n, "n"), (k, "k"), (d, "d"), (low, "low"), (high, "high"), (mode, "mode"), (reach, "reach"))]
    # Arrays of one element name a value that is used more than once.
    state = F.struct(*known, one.alias("above"), one.alias("below"), one.alias("sum"))
    summed = F.transform(
        F.array(state),
        lambda s: F.aggregate(F.sequence(F.lit(1).cast("long"), s["reach"]), s, lambda a, i: outward(a, i.cast("double"), None)),
    )
    drawn_ = F.transform(
        summed,
        lambda s: F.aggregate(
            F.sequence(F.lit(1).cast("long"), s["reach"]),
            F.struct(
                *[s[f].alias(f) for f in ("n", "k", "d", "low", "high", "mode", "reach")],
                one.alias("above"),
                one.alias("below"),
                (u * s["sum"] - 1).alias("left"),
                F.when(u * s["sum"] < 1, s["mode"]).otherwise(-1.0).alias("found"),
            ),
            lambda a, i: outward(a, i.cast("double"), a["left"]),
            lambda a: F.when(a["found"] < 0, a["mode"]).otherwise(a["found"]).cast("long"),
        ),
    )
    return F.element_at(drawn_, 1)


def _left_counts(wanted: str, in_left: Column, *key) -> Column:
    """Multivariate draw: how much of each shard's `wanted` count comes from the `in_left` rows of the left half."""
    zero = F.lit(0).cast("long")
    start = F.struct(
        F.aggregate(wanted, zero, lambda a, x: a + x).alias("total"),
        in_left.alias("left"),
        F.array().cast("array<bigint>").alias("counts"),
    )

    def shard(state: Column, good: Column) -> Column:
        count = hypergeometric(
            state["total"], good, state["left"], _uniform(*key, F.size(state["counts"]))
        )
        return F.element_at(
            F.transform(
                F.array(count),
                lambda c: F.struct(
                    (state["total"] - good).alias("total"),
                    (state["left"] - c).alias("left"),
                    F.concat(state["counts"], F.array(c)).alias("counts"),
                ),
            ),
            1,
        )

    return F.aggregate(wanted, start, shard, lambda a: a["counts"])


def communication_matrix(sizes: DataFrame, levels: int, shards: int, seed: int) -> DataFrame:
    """(part, counts) for 2**levels partitions, from (part, n) with every partition present."""
    total = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)
    node = (
        sizes.groupBy()
        .agg(F.array_sort(F.collect_list(F.struct("part", "n"))).alias("sizes"))
        .select(F.lit(0).cast("long").alias("part"), F.transform("sizes", lambda x: x["n"]).alias("sizes"))
        .withColumn("total", total)
        .select(
            "part",
            "sizes",
            F.transform(
                F.sequence(F.lit(0), F.lit(shards - 1)),
                lambda s: F.floor(F.col("total") / shards) + (s < F.col("total") % shards).cast("long"),
            ).alias("counts"),
        )
    )
    for level in range(levels):
        if level == SPREAD_LEVEL:
            node = node.repartition(SPREAD_TASKS, "part")
        half = 1 << (levels - level - 1)
        left_sizes = F.slice("sizes", 1, half)
        in_left = F.aggregate(left_sizes, F.lit(0).cast("long"), lambda a, x: a + x)
        left = _left_counts("counts", in_left, "part", F.lit(level), F.lit(seed))
        both = F.transform(
            F.array(left),
            lambda x: F.array(
                F.struct((F.col("part") * 2).alias("part"), left_sizes.alias("sizes"), x.alias("counts")),
                F.struct(
                    (F.col("part") * 2 + 1).alias("part"),
                    F.slice("sizes", half + 1, half).alias("sizes"),
                    F.zip_with("counts", x, lambda c, l: c - l).alias("counts"),
                ),
            ),
        )
        node = node.select(F.inline(F.element_at(both, 1)))
    return node.select("part", "counts")


def _doublings(n: int, per: int, least: int) -> int:
    """The least k with 2**k buckets of about `per` rows or fewer, and `least` buckets at least."""
    return (max(least, -(-n // per)) - 1).bit_length()


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32): UTF-8 bytes of the text plus 16, and their checksum."""
    return docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
    )


def shard(rows: DataFrame, key: list[str], shards: int = 40, seed: int = 1) -> DataFrame:
    """Every row with its shard and its slot in it (0, 1, ...); shards differ by one row at most.

    `key` are the columns whose hash is the row's randomness. `rows` is read several times:
    give it a written table. Its columns may not be called as the ones added here.
    """
    n = rows.count()
    levels = _doublings(n, PART_ROWS, LEAST_PARTS)
    parts = rows.withColumn("part", F.shiftrightunsigned(F.xxhash64(*key, F.lit(seed)), 64 - levels))
    present = parts.groupBy("part").agg(F.count("*").alias("n"))
    every = rows.sparkSession.range(1 << levels).select(F.col("id").alias("part"))
    sizes = every.join(present, "part", "left").select("part", F.coalesce("n", F.lit(0).cast("long")).alias("n"))
    matrix = materialise(communication_matrix(sizes, levels, shards, seed), "matrix")
    bounds = F.aggregate(
        "counts",
        F.array(F.lit(0).cast("long")),
        lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)),
    )
    dealt = matrix.select("part", bounds.alias("bounds"))
    local = Window.partitionBy("part").orderBy(F.xxhash64(*key, F.lit(seed + 1)))
    width = _doublings(-(-n // shards), BUCKET_ROWS, LEAST_BUCKETS)
    second = F.xxhash64(*key, F.lit(seed + 2))
    sent = materialise(
        parts.withColumn("place", F.row_number().over(local) - 1)
        .join(dealt, "part")
        .withColumn("shard", F.size(F.filter("bounds", lambda b: b <= F.col("place"))) - 1)
        .withColumn("second", second)
        .withColumn("bucket", F.shiftrightunsigned("second", 64 - width))
        .drop("part", "place", "bounds"),
        "sent",
    )
    earlier = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        sent.groupBy("shard", "bucket")
        .agg(F.count("*").alias("n"))
        .select("shard", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    )
    within = Window.partitionBy("shard", "bucket").orderBy("second", *key)
    return (
        sent.withColumn("slot", F.row_number().over(within) - 1)
        .join(before, ["shard", "bucket"])
        .withColumn("slot", (F.col("slot") + F.col("before")).cast("long"))
        .drop("bucket", "second", "before")
    )


def sharded(docs: DataFrame, shards: int = 40, seed: int = 1) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of all documents."""
    rows = materialise(measured(docs), "sizes")
    return shard(rows, ["doc_id", "size", "text_crc32"], shards, seed)


def with_shards(docs: DataFrame, shards: int = 40, seed: int = 1) -> DataFrame:
    """The documents with all their columns, and size, text_crc32, shard and slot.

    Only sizes and checksums are permuted; the rows themselves are joined once, at the end, by a number of their own. An added name
    that the table has already gets underscores in front.
    """
    row = free_name(docs, "row_number")
    held = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size")
    slim = held.select(F.col(row).alias("row"), "doc_id", size, F.crc32(F.col("text").cast("binary")).alias("text_crc32"))
    dealt = shard(materialise(slim, "sizes"), ["doc_id", "size", "text_crc32"], shards, seed)
    added = {c: free_name(docs, c) for c in ("size", "text_crc32", "shard", "slot")}
    of = free_name(docs, "row_of")
    dealt = materialise(dealt.select(F.col("row").alias(of), *[F.col(c).alias(n) for c, n in added.items()]), "dealt")
    return held.join(dealt, held[row] == dealt[of]).drop(row, of)
