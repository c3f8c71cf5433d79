"""From raw documents to shards: five stages, each a Spark job over all that the stage before it kept."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridpanel.llm import decontaminate, jaccard, language, mixing, scratch, sharding
from gridpanel.llm.scratch import materialise

#: Intermediate tables of the stages so far.
_TABLES: list[str] = []


def _stage(function):
    """A stage that first removes the tables of earlier ones: its input is written, so nothing else reads them.

    Tables that the given documents read themselves, where they were not written, stay.
    """

    @wraps(function)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        scratch.release(spark, _TABLES, docs)
        before = set(scratch.tables())
        result = function(spark, docs, sf_dir)
        _TABLES.extend(path for path in scratch.tables() if path not in before)
        return result

    return run


@_stage
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the models recognise."""
    return language.accepted(docs)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of Jaccard similarity 0.75 hold together."""
    return jaccard.representatives(docs)


@_stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_stage
def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; sources come near their target weights."""
    return mixing.mixed(docs)


@_stage
def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row of the mix with all its columns, its shard and its slot."""
    return sharding.with_shards(docs).withColumn("law", F.lit("rows"))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("source_mixing", source_mixing),
    ("sharding", shards),
]

#: Two stages fit models or draw at random, which SQL cannot express; the tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage is written and read again by the next one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
