"""Benchmark decontamination as a prefix-filtered join of shingles.

A window is a run of 13 words of a benchmark item; an item of fewer words is one window. A
window occurs in a document where its words stand one after another, so all of its shingles
(five words; fewer in a window of fewer) do. The rarest of them is therefore a necessary
prefix of length one: shingles are ordered by how often all documents hold them, windows and
documents are joined on each window's rarest shingle alone, the shingle's place in the window
fixes where the window would begin (positional bound) and whether the text around is long
enough (length bound), and the words of that stretch are compared one by one.

Documents are cut into words once. A Bloom filter of fixed size over the benchmark's shingles
keeps only stretches that may hold a window; everything after that pass is as small as
the contamination, and all joins are plain equi-joins that adaptive execution may split.

Defined results: a null or empty text has no words, so it is neither hit nor contaminated; an
item without words has no windows; equal items each count; rows that repeat a doc_id are
judged one by one; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpanel.llm import bloom, text
from gridpanel.llm.scratch import materialise

SHINGLE = 5

_ITEM = "item_id {id}, window string, n int, keys array<struct<at: int, hash: bigint>>"
_RUNS = "array<struct<start: int, words: array<string>, keys: array<struct<at: int, hash: bigint>>>>"


def _spelled(data: np.ndarray, words: text.Words, table: np.ndarray, lo: int, hi: int) -> list[str]:
    """Words number lo to hi, as compared."""
    codes = table[data[words.start[lo] : words.end[hi - 1]]].tobytes()
    base = int(words.start[lo])
    return [codes[s - base : e - base].decode() for s, e in zip(words.start[lo:hi], words.end[lo:hi])]


def _signed(hashes: np.ndarray) -> list[int]:
    return hashes.view(np.int64).tolist()


def _windows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text.column_bytes(batch.column(1))
            found = text.words(data, offsets, text.ALNUM)
            rows = []
            for item, key in enumerate(batch.column(0).to_pylist()):
                span = found.of(item)
                n = span.stop - span.start
                if not n:
                    continue
                spelled = _spelled(data, found, text.ALNUM, span.start, span.stop)
                length = min(size, n)
                hashes = _signed(text.shingles(found.hash[span], min(SHINGLE, n)))
                per_window = length - min(SHINGLE, n) + 1
                for at in range(n - length + 1):
                    keys = [{"at": k, "hash": hashes[at + k]} for k in range(per_window)]
                    rows.append((key, " ".join(spelled[at : at + length]), length, keys))
            fields = [
                batch.schema.field(0).with_name("item_id"),
                pa.field("window", pa.string()),
                pa.field("n", pa.int32()),
                pa.field("keys", pa.list_(pa.struct([("at", pa.int32()), ("hash", pa.int64())]))),
            ]
            columns = list(zip(*rows)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=f.type) for c, f in zip(columns, fields)], schema=pa.schema(fields)
            )

    return run


def _scan(filter_: bloom.Bloom, sizes: list[int]):
    """Per document: number of words, and the stretches covered by shingles of the benchmark."""
    runs_type = pa.list_(
        pa.struct(
            [
                ("start", pa.int32()),
                ("words", pa.list_(pa.string())),
                ("keys", pa.list_(pa.struct([("at", pa.int32()), ("hash", pa.int64())]))),
            ]
        )
    )

    def document(data: np.ndarray, found: text.Words, span: slice) -> list[dict]:
        hashes = found.hash[span]
        places, keys, lengths = [], [], []
        for size in sizes:
            all_keys = text.shingles(hashes, size)
            hit = np.flatnonzero(filter_.holds(all_keys))
            places.append(hit)
            keys.append(all_keys[hit])
            lengths.append(np.full(len(hit), size))
        at = np.concatenate(places)
        if not len(at):
            return []
        key, length = np.concatenate(keys), np.concatenate(lengths)
        order = np.argsort(at, kind="stable")
        at, key, length = at[order], key[order], length[order]
        reach = np.maximum.accumulate(at + length)
        cut = np.flatnonzero(at[1:] > reach[:-1]) + 1
        runs = []
        for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(at)]):
            start, stop = int(at[lo]), int(reach[hi - 1])
            runs.append(
                {
                    "start": start,
                    "words": _spelled(data, found, text.ALNUM, span.start + start, span.start + stop),
                    "keys": [
                        {"at": int(a) - start, "hash": h} for a, h in zip(at[lo:hi], _signed(key[lo:hi]))
                    ],
                }
            )
        return runs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_bytes, all_offsets = text.column_bytes(batch.column(2))
            for lo, hi in text.groups_of_texts(all_offsets):
                data = all_bytes[all_offsets[lo] : all_offsets[hi]]
                found = text.words(data, all_offsets[lo : hi + 1] - all_offsets[lo], text.ALNUM)
                runs = [document(data, found, found.of(i)) for i in range(hi - lo)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        batch.column(1).slice(lo, hi - lo),
                        pa.array(np.diff(found.first), type=pa.int64()),
                        pa.array(runs, type=runs_type),
                    ],
                    names=["row", "doc_id", "n_words", "runs"],
                )

    return run


def occurrences(docs: DataFrame, items: DataFrame, window: int = 13, log2_bits: int = 24):
    """Scanned documents (row, doc_id, n_words), occurrences (row, start, n, window), and windows of items."""
    id_type = items.schema["item_id"].dataType.simpleString()
    windows = materialise(
        items.select("item_id", "text").mapInArrow(_windows(window), _ITEM.format(id=id_type)), "windows"
    )
    distinct = windows.dropDuplicates(["window"]).select("window", "n", "keys")
    keys = distinct.select("window", "n", F.size("keys").alias("n_keys"), F.inline("keys"))
    filter_ = bloom.build(keys.select("hash").distinct(), "hash", log2_bits)
    sizes = [r[0] for r in windows.select(F.least("n", F.lit(SHINGLE))).distinct().collect()]
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    scanned = materialise(
        docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(
            _scan(filter_, sorted(sizes) or [SHINGLE]),
            f"row bigint, doc_id {doc_type}, n_words bigint, runs {_RUNS}",
        ),
        "scanned",
    )
    around = window - 1
    held = scanned.select("row", F.inline("runs")).select("row", "start", "words", F.inline("keys").alias("at", "hash"))
    counts = held.groupBy("hash").agg(F.count("*").alias("n_rows"))
    # A window with a shingle that no document holds occurs nowhere.
    prefix = (
        keys.join(counts, "hash")
        .groupBy("window", "n", "n_keys")
        .agg(F.count("*").alias("held"), F.min(F.struct("n_rows", "hash", "at")).alias("rarest"))
        .where("held = n_keys")
        .select("window", "n", F.col("rarest.hash").alias("hash"), F.col("rarest.at").alias("offset"))
    )
    first = F.greatest(F.col("at") - around, F.lit(0))
    candidates = (
        held.select(
            "row",
            "hash",
            (F.col("start") + F.col("at")).alias("at"),
            (F.col("at") - first).alias("before"),
            F.slice("words", first + 1, F.lit(2 * around + 1)).alias("words"),
        )
        .join(materialise(prefix, "prefix"), "hash")
        .where("before >= offset and before - offset + n <= size(words)")
        .where(F.array_join(F.slice("words", F.expr("before - offset + 1"), F.col("n")), " ") == F.col("window"))
    )
    found = materialise(
        candidates.select("row", (F.col("at") - F.col("offset")).alias("start"), "n", "window"), "occurrences"
    )
    return scanned.select("row", "doc_id", "n_words"), found, windows.select("window", "item_id")


def contamination(docs: DataFrame, items: DataFrame, window: int = 13, share: int = 20) -> DataFrame:
    """One row per document: how many of its words lie in windows of items, and of which items.

    Contaminated is a document of which at least one in `share` words is hit.
    """
    scanned, found, windows = occurrences(docs, items, window)
    covered = F.aggregate(
        F.array_sort(F.collect_set(F.struct("start", "n"))),
        F.struct(F.lit(0).alias("to"), F.lit(0).cast("long").alias("hit")),
        lambda a, x: F.struct(
            F.greatest(a["to"], x["start"] + x["n"]).alias("to"),
            (
                a["hit"] + F.greatest(F.lit(0), x["start"] + x["n"] - F.greatest(x["start"], a["to"]))
            ).alias("hit"),
        ),
        lambda a: a["hit"],
    )
    hits = found.groupBy("row").agg(covered.alias("n_hit"))
    ids = (
        found.select("row", "window")
        .distinct()
        .join(windows.distinct(), "window")
        .groupBy("row")
        .agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    )
    items_ = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return (
        scanned.join(hits, "row", "left")
        .join(ids, "row", "left")
        .select(
            "doc_id",
            "n_words",
            n_hit.alias("n_hit"),
            F.size(items_).cast("long").alias("n_items"),
            F.sha2(F.array_join(items_, ",").cast("binary"), 256).alias("items_sha256"),
            ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"),
        )
    )


def decontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with all their columns.

    A row leaves by doc_id and the digest of its text, which decides alone, so rows that share
    a doc_id, or have none, stay or leave one by one.
    """
    digest = F.md5(docs["text"].cast("binary"))
    keyed = docs.select(F.struct(docs["doc_id"].alias("id"), digest.alias("digest")).alias("doc_id"), docs["text"])
    bad = contamination(keyed, items).where("contaminated").select("doc_id.id", "doc_id.digest").distinct()
    bad = materialise(bad, "contaminated")
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["id"]) & (digest == bad["digest"]), "left_anti")
