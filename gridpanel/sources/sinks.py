"""Writing tables, result sets and the text report."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from gridpanel.operators.quality import report_lines
from gridpanel.sources.readers import format_of, path_exists, read_table


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A table by its extension; CSV gets a header."""
    kind = format_of(path)
    writer = df.write.mode(mode)
    if kind == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.parquet(path)


def save_results(
    results: Mapping[str, DataFrame],
    folder: str,
    prefix: str = "analysis",
    timestamp: bool | str = True,
    kind: str = "parquet",
) -> dict[str, str]:
    """Each part under `folder/prefix_<part>[_<timestamp>].<kind>`; the paths written.

    The manifest `folder/prefix_manifest.<kind>` lists the parts of the last save.
    """
    stamp = ""
    if timestamp:
        stamp = "_" + (timestamp if isinstance(timestamp, str) else datetime.now().strftime("%Y%m%d_%H%M%S"))
    written, spark = {}, None
    for part, df in results.items():
        name = f"{prefix}_{part}{stamp}.{kind}"
        written[part] = f"{folder.rstrip('/')}/{name}"
        write_table(df, written[part])
        spark = df.sparkSession
    if spark is not None:
        rows = [(part, path.rpartition("/")[2]) for part, path in written.items()]
        write_table(spark.createDataFrame(rows, "part string, name string"), _manifest(folder, prefix, kind))
    return written


def _manifest(folder: str, prefix: str, kind: str) -> str:
    return f"{folder.rstrip('/')}/{prefix}_manifest.{kind}"


def load_results(
    spark: SparkSession,
    folder: str,
    parts: Sequence[str] | None = None,
    prefix: str = "analysis",
    kind: str = "parquet",
) -> dict[str, DataFrame]:
    """The parts of the last save, or those named; names that were not saved are skipped."""
    manifest = _manifest(folder, prefix, kind)
    if not path_exists(spark, manifest):
        return {}
    # One row per part of an analysis.
    saved = {row["part"]: row["name"] for row in read_table(spark, manifest).collect()}
    wanted = saved if parts is None else [p for p in parts if p in saved]
    return {part: read_table(spark, f"{folder.rstrip('/')}/{saved[part]}") for part in wanted}


def write_report(report: Mapping[str, DataFrame], path: str) -> None:
    """The quality report as one text file; its length depends on the columns, not the rows."""
    lines = report_lines(dict(report)).select("line")
    lines.coalesce(1).write.mode("overwrite").text(path)
