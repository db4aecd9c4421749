"""A ledger of the files a conversion has seen: path, time and length, and what became of each.

A version of the ledger is one table in a folder of its own. It counts only when it is complete, so a
run that dies leaves the version before it, and the next run takes the same files again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomark.operators.spool import remove

STATE = "path string, modificationTime timestamp, length long, outcome string, error string, run long"
# What became of a file since the last run.
NEW, REWRITTEN, RETRIED, UNCHANGED, DELETED = "new", "rewritten", "retried", "unchanged", "deleted"
#: complete versions that stay; older ones are removed
KEPT = 2


class Ledger:
    """The versions of a ledger in a folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def versions(self) -> list[int]:
        """The complete versions in order."""
        jvm = self.spark._jvm.org.apache.hadoop.fs
        root = jvm.Path(self.folder)
        system = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not system.exists(root):
            return []
        names = [s.getPath().getName() for s in system.listStatus(root) if s.isDirectory()]
        numbers = [int(n[2:]) for n in names if n.startswith("v=") and n[2:].isdigit()]
        return sorted(n for n in numbers if system.exists(jvm.Path(f"{self.folder}/v={n}/_SUCCESS")))

    def run(self) -> int:
        """The number of the next run; the same again as long as it has not been committed."""
        return (self.versions() or [0])[-1] + 1

    def state(self) -> DataFrame:
        """The files of the last complete version (``STATE``)."""
        versions = self.versions()
        if not versions:
            return self.spark.createDataFrame([], STATE)
        return self.spark.read.schema(STATE).parquet(f"{self.folder}/v={versions[-1]}")

    def fates(self, listed: DataFrame, retry: bool = False) -> DataFrame:
        """One row for every file now or before: ``path, modificationTime, length, fate`` and its old outcome.

        A file is rewritten when its time or length differs. With ``retry``, unchanged files that
        failed are taken again.
        """
        before = self.state().select(
            "path", F.col("modificationTime").alias("old_time"), F.col("length").alias("old_length"),
            F.col("outcome").alias("old_outcome"), F.col("error").alias("old_error"), F.col("run").alias("old_run"),
        )
        both = listed.select("path", "modificationTime", "length", F.lit(True).alias("here")).join(before, "path", "full")
        same = F.col("modificationTime").eqNullSafe(F.col("old_time")) & F.col("length").eqNullSafe(F.col("old_length"))
        fate = (
            F.when(F.col("here").isNull(), DELETED)
            .when(F.col("old_run").isNull(), NEW)
            .when(~same, REWRITTEN)
            .when(F.lit(retry) & (F.col("old_outcome") == "failed"), RETRIED)
            .otherwise(UNCHANGED)
        )
        kept = ("old_outcome", "old_error", "old_run")
        return both.select("path", "modificationTime", "length", fate.alias("fate"), *kept)

    def commit(self, state: DataFrame, run: int) -> None:
        """Write version ``run``; an incomplete one of that number is replaced."""
        state.select("path", "modificationTime", "length", "outcome", "error", "run").write.mode("overwrite").parquet(f"{self.folder}/v={run}")
        for old in self.versions()[:-KEPT]:
            remove(self.spark, f"{self.folder}/v={old}")
