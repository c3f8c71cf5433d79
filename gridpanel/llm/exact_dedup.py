"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by digest, one row per distinct text ever seen:
(digest, keep_id, batch). A batch of new documents is reduced to its distinct digests with
map-side combination, a sort-merge anti-join with the index (whose side is neither shuffled nor
collected) finds those never seen, and they are appended under the batch's number. So a hot
digest meets the index as one row.

Texts are equal if they are after each run of U+0020, U+0009 to U+000D became one space.

Defined results: a null text is an empty one, and all of those are equal; of equal texts in a
batch the row with the smallest doc_id stays (null ids last; rows that share that id all stay);
a text that an earlier batch holds leaves no row of a later batch; other columns are not read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridpanel.llm.scratch import materialise

BLANKS = r"[\x20\x09-\x0D]+"
BUCKETS = 64


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest): SHA-256 of the normalised text, 32 bytes."""
    normal = F.regexp_replace(F.coalesce("text", F.lit("")), BLANKS, " ")
    return docs.select("doc_id", F.unhex(F.sha2(normal.cast("binary"), 256)).alias("digest"))


class DigestIndex:
    """The index as a table of the catalog; `buckets` is fixed when it is made."""

    def __init__(self, spark: SparkSession, table: str, buckets: int = BUCKETS):
        self.spark, self.table, self.buckets = spark, table, buckets

    def _write(self, rows: DataFrame) -> None:
        (
            rows.write.bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .format("parquet")
            .mode("append")
            .saveAsTable(self.table)
        )

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.table)

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def files(self) -> DataFrame:
        """The same rows as plain files, so that a join may deal them out anew and split hot keys."""
        return self.spark.read.schema(self.rows().schema).parquet(*self.rows().inputFiles())

    def append(self, fresh: DataFrame, batch: int) -> None:
        """Add the digests of `fresh` (digest, keep_id, n) that the index lacks."""
        if not self.exists():
            self._write(fresh.limit(0).select("digest", "keep_id", F.lit(batch).cast("long").alias("batch")))
        new = fresh.hint("merge").join(self.rows().hint("merge"), "digest", "left_anti")
        self._write(new.select("digest", "keep_id", F.lit(batch).cast("long").alias("batch")))


def deduplicate(docs: DataFrame, index: DigestIndex, batch: int) -> DataFrame:
    """Append a batch; one row per document with the row that stays and the size of its group in the batch."""
    named = materialise(digests(docs), "digests")
    groups = materialise(
        named.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "groups"
    )
    index.append(groups.select("digest", "keep_id"), batch)
    held = index.files() if index.rows().inputFiles() else index.rows()
    stays = groups.select("digest", "group_size").join(held, "digest")
    return named.join(materialise(stays, "stays"), "digest").select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("batch") == batch)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def new_index(spark: SparkSession) -> DigestIndex:
    """An index of its own, below the warehouse folder."""
    return DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}")
