"""A table of run results that survives restarts: one commit per run, repeated commits change nothing."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from ..sources.io import union_all


def run_id(tags: Mapping, *inputs) -> str:
    """Name of a run: its tags and everything else that its rows depend on."""
    return hashlib.sha256(repr((sorted(tags.items()), inputs)).encode()).hexdigest()[:24]


class ResultTable:
    """Rows of runs below a shared folder, one Parquet folder per run.

    A run counts once Spark has written the ``_SUCCESS`` file of its folder, which it does last.  What a
    broken attempt left is never read, and the next attempt overwrites it.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _path(self, *below: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *below)))

    def committed(self) -> set[str]:
        top = self._path()
        files = top.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(top):
            return set()
        names = [f.getPath().getName() for f in files.listStatus(top) if f.isDirectory()]
        return {n.removeprefix("run=") for n in names if n.startswith("run=") and files.exists(self._path(n, "_SUCCESS"))}

    def commit(self, run: str, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/run={run}")

    def read(self, runs: list[str] | None = None) -> DataFrame:
        """Rows of the given runs, by default of all committed ones."""
        runs = sorted(self.committed()) if runs is None else runs
        if not runs:
            raise ValueError(f"no committed runs in {self.path}")
        return union_all([self.spark.read.parquet(f"{self.path}/run={r}") for r in runs])
