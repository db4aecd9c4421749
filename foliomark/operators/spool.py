"""Written intermediate tables: a cut in the lineage that survives lost executors."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting for the most bytes that Python gets at once
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder the session names in ``spark.checkpoint.dir``.

    Where it is unset, as in tests, the context's own checkpoint folder is used, and failing that
    one below the session's warehouse, which driver and executors share as well.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints"
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


@contextmanager
def arrow_batches(spark: SparkSession, limit: int | None) -> Iterator[None]:
    """Jobs started inside hand Python batches of about ``limit`` bytes, unless the session sets a size itself.

    Spark's own limits are 10,000 rows and 64 MB, and both the JVM and Python hold copies of a batch.
    """
    own = limit is not None and ARROW_BYTES not in spark.conf.getAll
    if own:
        spark.conf.set(ARROW_BYTES, str(limit))
    try:
        yield
    finally:
        if own:
            spark.conf.unset(ARROW_BYTES)


class Scratch:
    """Owner of spooled tables: ``drop`` deletes some of them, ``release`` all."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        self.paths: dict[int, str] = {}

    def spool(self, df: DataFrame, partitions: int | None = None, batch_bytes: int | None = None) -> DataFrame:
        """Write ``df`` once and read it back, so that its work is never repeated.

        ``batch_bytes``: about how much its Python steps get at once.
        """
        self.count += 1
        path = f"{self.root}/{self.count}"
        with arrow_batches(self.spark, batch_bytes):
            (df if partitions is None else df.coalesce(partitions)).write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(back)] = path
        return back

    def drop(self, *frames: DataFrame) -> None:
        """Delete spooled tables that nothing will read any more."""
        for frame in frames:
            path = self.paths.pop(id(frame), None)
            if path:
                remove(self.spark, path)

    def keep(self, *frames: DataFrame) -> None:
        """Delete all spooled tables but these."""
        kept = {id(frame) for frame in frames}
        for key in [k for k in self.paths if k not in kept]:
            remove(self.spark, self.paths.pop(key))

    def release(self) -> None:
        """Delete everything of this owner; tables read from it are of no use afterwards."""
        self.paths.clear()
        remove(self.spark, self.root)


def spool(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back, so that its work is never repeated."""
    path = f"{checkpoint_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system, wherever it is."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
