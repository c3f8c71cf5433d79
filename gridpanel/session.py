"""Session settings the operators are written for."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "128m",
    "spark.sql.session.timeZone": "UTC",
}


def build_session(app_name: str = "gridpanel", master: str | None = None, **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster; a temporary one only where none is named."""
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        folder = tempfile.mkdtemp(prefix="gridpanel-checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


@contextmanager
def arrow_batches(spark: SparkSession, size: str) -> Iterator[None]:
    """What runs within passes rows to Python in batches of about `size` bytes instead of the session's own limit.

    A batch is held several times over: in Spark's buffers outside the heap, which double as they grow, and in Python.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: Tables of `written` that are still there, in order.
_TEMPORARY: list[str] = []


def temporary_tables() -> list[str]:
    return list(_TEMPORARY)


def drop_temporary(spark: SparkSession, kept: list[str]) -> None:
    """Remove the tables of `written` but those kept; nothing may read them any more."""
    for path in [p for p in _TEMPORARY if p not in kept]:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        _TEMPORARY.remove(path)


def written(df: DataFrame) -> DataFrame:
    """The table, written once below the checkpoint folder and read back.

    Unlike `checkpoint`, nothing of the plan before it is kept, not even its constraints, which
    would double with every round of an iteration.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _TEMPORARY.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
