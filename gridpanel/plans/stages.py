"""Stages of a long run: each is written and committed once, and a rerun goes on behind the last committed one."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from gridpanel.session import drop_temporary, temporary_tables
from gridpanel.sources.readers import path_exists, remove_path

_MANIFEST = "table string, path string"


@dataclass(frozen=True)
class Stages:
    """Results below a folder, one subfolder per stage.

    A stage's tables are written to a folder of the attempt, then its manifest, a table of their names and paths. Spark
    marks a finished table at last, so a stage counts once its manifest is finished; what a failed attempt
    left is removed by the next one.
    """

    spark: SparkSession
    folder: str

    def _manifest(self, stage: str) -> str:
        return f"{self.folder.rstrip('/')}/{stage}/manifest"

    def committed(self, stage: str) -> bool:
        return path_exists(self.spark, f"{self._manifest(stage)}/_SUCCESS")

    def tables(self, stage: str, make: Callable[[], Mapping[str, DataFrame]]) -> dict[str, DataFrame]:
        """The stage's tables as committed, made now if they are not.

        Temporary tables that `make` and the writing used are removed at the commit.
        """
        if not self.committed(stage):
            remove_path(self.spark, f"{self.folder.rstrip('/')}/{stage}")
            before = temporary_tables()
            attempt, rows = f"{self.folder.rstrip('/')}/{stage}/{uuid.uuid4().hex}", []
            for name, table in make().items():
                rows.append((name, f"{attempt}/{name}"))
                table.write.parquet(rows[-1][1])
            manifest = self.spark.createDataFrame(rows, _MANIFEST).coalesce(1)
            manifest.write.parquet(self._manifest(stage))
            drop_temporary(self.spark, before)
        # One row for each table of a stage.
        rows = self.spark.read.schema(_MANIFEST).parquet(self._manifest(stage)).collect()
        return {row["table"]: self.spark.read.parquet(row["path"]) for row in rows}
