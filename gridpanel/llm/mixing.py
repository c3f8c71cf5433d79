"""Mixing of sources to target weights by a low-discrepancy schedule of equal-token blocks.

Targets: sources, ordered by name with null last, weigh 5, 2, 1, 5, 2, 1, ... and share all
words. No target exceeds `most` times its source's words; what is above goes to the others by
weight. With every source below or at its cap this is one level L with target = min(weight * L,
cap), which sorting by cap / weight gives in closed form.

Blocks: each source's documents are shuffled by a hash and laid end to end in a row of words, which is
read around, block after block, until the source's target is reached; a source's number of slots is
what its target needs, the last one cut short. Schedule: slot i of the mix gets the point frac(i * golden
ratio), the cumulative numbers of slots say which source owns that point, and the slot's rank among the
slots of its source says which block it takes. Any stretch of the mix holds each source in its share up to a few
blocks. A source that has all its slots leaves later points empty; TRIES points for each slot are enough for all
sources to get theirs. Blocks change the order of the mix, never how much is taken.

Whole documents (`mixed`) are as often in the mix as its slots begin them.

Ranks and running sums are distributed: they are taken within parts of a source or of the
schedule, whose totals are summed up in a table of parts. Only the table of sources, one row
each, is ordered in one task.

Defined results: a null or empty text has no words, so nothing is taken of it; a null source is
a source; rows that repeat a doc_id count each; without words no target exists (0) and nothing
is taken; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridpanel.llm.scratch import beside, free_name, materialise

#: Weights in the order of the sources.
WEIGHTS = (5, 2, 1)
#: Points are multiples of 2**-31. A step is the number next to the golden ratio's fraction whose continued fraction has no
#: term above 3, so that 5 * n points in a row leave no interval of length 1 / n empty.
POINTS = 1 << 31
STEP = 1327220129
WORD = r"[^\x20\x09-\x0D]+"
#: Words of a block; beyond 2**29 blocks in a mix, choose longer ones.
BLOCK = 1 << 12
#: Points for each slot of the mix.
TRIES = 5
PART_ROWS = 1 << 12
SLOTS = 1 << 15
CELLS = 1 << 10


def measured(docs: DataFrame, row: Column | None = None) -> DataFrame:
    """(row, doc_id, source, size, digest): words of each text; rows are numbered here if `row` is not given."""
    return docs.select(
        (F.monotonically_increasing_id() if row is None else row).alias("row"),
        "doc_id",
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64("text").alias("digest"),
    )


def targets(sizes: DataFrame, most: int = 3) -> DataFrame:
    """(source, source_size, n_docs, number, target, words) from (doc_id, source, size).

    `words` is the target as a whole number, at least one word of a source that has any. One row for each source is ordered in one
    task.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    everything = Window.partitionBy(F.lit(0))
    by_name = everything.orderBy(F.col("source").asc_nulls_last())
    by_cap = everything.orderBy("ratio", "number")
    weighed = (
        sources.withColumn("number", F.row_number().over(by_name) - 1)
        .withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("number") % len(WEIGHTS) + 1).cast("int")))
        .withColumn("cap", most * F.col("source_size"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything))
        # The level if all sources before this one stop at their caps and no other does.
        .withColumn("capped", F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("open", F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.coalesce("capped", F.lit(0))) / F.col("open"))
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "number", "level"))).over(everything)["level"])
    )
    target = F.least(F.col("weight") * F.col("level"), F.col("cap").cast("double"))
    words = F.when(F.col("source_size") > 0, F.greatest(F.round(target).cast("long"), F.lit(1))).otherwise(F.lit(0))
    return weighed.select(
        "source",
        "source_size",
        "n_docs",
        "number",
        target.alias("target"),
        words.cast("long").alias("words"),
    )


def _running(df: DataFrame, keys: list[str], part: str, value: str, out: str) -> DataFrame:
    """Sum of `value` over all earlier parts of the same keys, attached to each (keys, part)."""
    earlier = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.coalesce(F.sum(value).over(earlier), F.lit(0)).cast("long"))


def laid_out(sizes: DataFrame, sources: DataFrame, seed: int = 1) -> DataFrame:
    """Documents with their first word's place in the shuffled row of their source."""
    n_parts = F.ceil(F.col("n_docs") / PART_ROWS)
    numbered = sizes.join(
        sources.select("source", "number", "n_docs"), sizes["source"].eqNullSafe(sources["source"])
    ).select(
        "doc_id",
        "size",
        "number",
        "row",
        "digest",
        F.md5(F.concat_ws("/", F.col("doc_id").cast("string"), F.lit(str(seed))).cast("binary")).alias("key"),
        n_parts.alias("n_parts"),
    ).withColumn("part", F.pmod(F.conv(F.substring("key", 1, 8), 16, 10).cast("long"), F.col("n_parts")))
    parts = _running(
        numbered.groupBy("number", "part").agg(F.sum("size").alias("words")), ["number"], "part", "words", "before"
    ).select("number", "part", "before")
    within = Window.partitionBy("number", "part").orderBy("key", "size", "digest", "row").rowsBetween(Window.unboundedPreceding, 0)
    return (
        numbered.withColumn("to", F.sum("size").over(within))
        .join(parts, ["number", "part"])
        .select("row", "doc_id", "size", "number", (F.col("before") + F.col("to") - F.col("size")).alias("start"))
    )


def schedule(sources: DataFrame, n_slots: int, block: int) -> DataFrame:
    """(slot, number, rank, since, upto): the words of its source's row, read around, that each slot of the mix takes.

    `n_slots` is the number of all sources' slots together.
    """
    spark = sources.sparkSession
    in_order = Window.partitionBy(F.lit(0)).orderBy("number")
    shares = (
        sources.withColumn("quota", F.ceil(F.col("words") / block))
        .withColumn("to", F.sum("quota").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("to", F.floor(F.col("to") / F.lit(float(max(n_slots, 1))) * POINTS).cast("long"))
        .withColumn("from", F.coalesce(F.lag("to").over(in_order), F.lit(0).cast("long")))
        .where("from < to")
        .select("number", "from", "to", "quota", "words")
    )
    # Points and shares meet in equal cells of the unit interval, so the join is on the cell.
    width = POINTS // CELLS
    cells = shares.withColumn(
        "cell", F.explode(F.sequence(F.floor(F.col("from") / width), F.floor((F.col("to") - 1) / width)))
    )
    point = (F.col("id") % POINTS * STEP) % POINTS
    slots = (
        spark.range(TRIES * n_slots)
        .select(F.col("id").alias("slot"), point.alias("point"))
        .withColumn("cell", F.floor(F.col("point") / width))
        .join(cells, "cell")
        .where("point >= from and point < to")
        .select("slot", "number", "quota", "words", F.floor(F.col("slot") / SLOTS).alias("part"))
    )
    parts = _running(
        slots.groupBy("number", "part").agg(F.count("*").alias("n")), ["number"], "part", "n", "before"
    ).select("number", "part", "before")
    within = Window.partitionBy("number", "part").orderBy("slot")
    return (
        slots.withColumn("rank", F.row_number().over(within) - 1)
        .join(parts, ["number", "part"])
        .withColumn("rank", F.col("rank") + F.col("before"))
        .where("rank < quota")
        .select(
            "slot",
            "number",
            "rank",
            (F.col("rank") * block).alias("since"),
            F.least((F.col("rank") + 1) * block, F.col("words")).alias("upto"),
        )
    )


def _places(slots: DataFrame, sources: DataFrame, block: int) -> DataFrame:
    """(number, block_no, places): for each block of a row the ranges of words, array of (lo, hi), that slots take of it.

    A slot may run over the row's end several times; as no target is above a few times its source, so are a block's ranges.
    """
    size = F.col("source_size")
    passes = F.explode(F.sequence(F.floor(F.col("since") / size), F.floor((F.col("upto") - 1) / size))).alias("pass")
    ranges = (
        slots.join(sources.select("number", "source_size"), "number")
        .select("number", "since", "upto", "source_size", passes)
        .select(
            "number",
            F.greatest(F.col("since") - F.col("pass") * size, F.lit(0)).alias("lo"),
            F.least(F.col("upto") - F.col("pass") * size, size).alias("hi"),
        )
    )
    blocks = F.explode(F.sequence(F.floor(F.col("lo") / block), F.floor((F.col("hi") - 1) / block))).alias("block_no")
    return (
        ranges.select("number", "lo", "hi", blocks)
        .select(
            "number",
            "block_no",
            F.greatest("lo", F.col("block_no") * block).alias("lo"),
            F.least("hi", (F.col("block_no") + 1) * block).alias("hi"),
        )
        .groupBy("number", "block_no")
        .agg(F.collect_list(F.struct("lo", "hi")).alias("places"))
    )


def mix(docs: DataFrame, most: int = 3, seed: int = 1, block: int = BLOCK) -> DataFrame:
    """One row per document: size, its source's size and target, words taken and, as `copies`, how often the mix begins it."""
    return _mix(measured(docs), most, seed, block).drop("row")


def _mix(sizes: DataFrame, most: int, seed: int, block: int = BLOCK) -> DataFrame:
    sizes = materialise(sizes, "sizes")
    sources = materialise(targets(sizes, most), "sources")
    n_slots = sources.agg(F.sum(F.ceil(F.col("words") / block))).first()[0] or 0
    laid = materialise(laid_out(sizes, sources, seed), "laid")
    places = _places(schedule(sources, n_slots, block), sources, block)
    end = F.col("start") + F.col("size")
    last = F.greatest(end - 1, F.col("start"))
    pieces = laid.withColumn(
        "block_no", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor(last / block)))
    )
    overlap = F.aggregate(
        "places",
        F.lit(0).cast("long"),
        lambda n, x: n + F.greatest(F.least(end, x["hi"]) - F.greatest(F.col("start"), x["lo"]), F.lit(0)),
    )
    begun = F.size(F.filter("places", lambda x: (x["lo"] <= F.col("start")) & (F.col("start") < x["hi"])))
    taken = (
        pieces.join(places, ["number", "block_no"], "left")
        .select("row", "doc_id", "number", "size", F.coalesce(overlap, F.lit(0)).alias("n"), F.coalesce(begun, F.lit(0)).alias("begun"))
        .groupBy("row", "doc_id", "number", "size")
        .agg(F.sum("n").cast("long").alias("taken"), F.sum("begun").cast("long").alias("copies"))
    )
    return taken.join(sources, "number").select(
        "row", "doc_id", "source", "size", "source_size", "target", "taken", "copies"
    )


def mixed(docs: DataFrame, seed: int = 1) -> DataFrame:
    """The documents of the mix with all their columns, each as often as the mix begins it.

    Rows are told apart by a number, so rows that share a doc_id, or have none, have copies of their own.
    """
    row, times = free_name(docs, "mixed_row"), free_name(docs, "mixed_times")
    held = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    copies = _mix(measured(held, F.col(row)), 3, seed).select(F.col("row").alias(row), F.col("copies").cast("int").alias(times))
    return (
        beside(held, row, copies, times)
        .where(F.col(times) > 0)
        .withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times))))
        .drop(row, times)
    )
