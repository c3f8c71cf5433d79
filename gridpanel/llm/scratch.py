"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridpanel.session import ensure_checkpoint_dir


def new_path(spark: SparkSession, kind: str) -> str:
    """A path of its own below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{kind}-{uuid.uuid4().hex}"


#: Numbers of rows in one array of `beside`, as a power of 2.
LOG2_BLOCK = 10
#: Tables written by `materialise` and not deleted yet, in order.
_WRITTEN: list[str] = []


def materialise(df: DataFrame, kind: str = "table") -> DataFrame:
    """Write a table once and read it back: lineage ends here, and lost executors lose nothing."""
    path = new_path(df.sparkSession, kind)
    df.write.parquet(path)
    _WRITTEN.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(conf).delete(at, True)


def _folders(df: DataFrame) -> set[str]:
    return {file.rpartition("/")[0].rpartition("/")[2] for file in df.inputFiles()}


def delete(*tables: DataFrame | None) -> None:
    """Remove the files of tables made by `materialise` that nothing reads any more."""
    for df in tables:
        for name in _folders(df) if df is not None else ():
            for path in [p for p in _WRITTEN if p.rpartition("/")[2] == name]:
                _remove(df.sparkSession, path)
                _WRITTEN.remove(path)


def tables() -> list[str]:
    """Paths of the tables of `materialise` that are still there."""
    return list(_WRITTEN)


def release(spark: SparkSession, paths: list[str], kept: DataFrame) -> None:
    """Remove those of the given tables that `kept` does not read."""
    needed = _folders(kept)
    for path in [p for p in paths if p in _WRITTEN and p.rpartition("/")[2] not in needed]:
        _remove(spark, path)
        _WRITTEN.remove(path)


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores in front until no column of `df` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def beside(table: DataFrame, row: str, values: DataFrame, value: str) -> DataFrame:
    """A written table, numbered by `monotonically_increasing_id` in `row`, with the column `value` of (row, value).

    Every row needs its value. Values lie in arrays, one for each block of successive numbers, and take a few bits a row when
    written, so Spark can broadcast them beside far more rows than by (row, value); beyond that, rows are shuffled by their blocks.
    """
    block, of = free_name(table, "block"), free_name(table, "block_of")
    packed = (
        values.select(F.shiftright(row, LOG2_BLOCK).alias(of), row, value)
        .groupBy(of)
        .agg(F.array_sort(F.collect_list(F.struct(row, value))).alias(value))
        .select(of, F.transform(value, lambda x: x[value]).alias(value))
    )
    packed = materialise(packed, "beside")
    place = F.col(row).bitwiseAND(F.lit((1 << LOG2_BLOCK) - 1)).cast("int")
    joined = table.withColumn(block, F.shiftright(row, LOG2_BLOCK)).join(packed, F.col(block) == F.col(of))
    return joined.withColumn(value, F.get(value, place)).drop(block, of)
