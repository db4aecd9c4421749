"""Convert only the files that have not been converted yet."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from foliomark.operators.spool import Scratch
from foliomark.sources.files import PATTERN, relative_path
from foliomark.sources.ledger import NEW, RETRIED, REWRITTEN, Ledger
from foliomark.sources.listing import contents, listing
from foliomark.sources.stores import qualified

# Spark forgets files older than this, counted from the newest; copies may keep old dates.
ANY_AGE = "36500d"


def new_files(
    spark: SparkSession, folder: str, schema: StructType, source: str = "binaryFile",
    pattern: str | None = None, recursive: bool = False,
) -> DataFrame:
    """A stream of the files that appear in a folder, however old their dates are.

    A file is known by its path: one rewritten under its old path is not read again, and names that
    begin with ``_`` or ``.`` are hidden from streams; ``convert_changes`` takes both. ``recursive``
    takes subfolders too; mirror them with ``relative_path(path, qualified(spark, folder))``.
    """
    reader = spark.readStream.format(source).schema(schema).option("maxFileAge", ANY_AGE)
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(folder)


def convert_new(
    stream: DataFrame, step: Callable[[DataFrame], DataFrame], folder: str, checkpoint: str,
    tasks: int | None = None,
) -> StreamingQuery:
    """Convert everything that is new and stop; run again for what arrives later.

    ``step`` holds only stateless operators (a document is whole in its row), so the stream
    needs no state. Files seen are remembered in ``checkpoint`` and the file sink commits each
    batch once, so a restart repeats and loses nothing. ``tasks`` spreads a batch of few large
    files; without it a batch has the tasks its files give it.
    """
    spread = stream.repartition(tasks) if tasks else stream
    return (
        step(spread)
        .writeStream.format("parquet")
        .option("path", folder)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def convert_changes(
    spark: SparkSession, folder: str, step: Callable[[DataFrame], DataFrame], out: str, ledger: str,
    pattern: str = PATTERN, recursive: bool = False, retry: bool = False, scratch: Scratch | None = None,
) -> DataFrame:
    """Convert what is new, rewritten or (with ``retry``) failed before; one row of fate for every file.

    ``step`` takes files with ``rel_path`` and ``content`` and returns rows with their ``path`` and
    ``error``; a file of which it returns no row was ``rejected``, one with an error in any row ``failed``. Its rows go to ``out/run=n``. Files
    are known by path, time and length in ``ledger``, hidden names included, so nothing that lies in the folder is
    left without a row: ``path, fate, outcome, error``, where fate is new, rewritten, retried,
    unchanged or deleted. A run that dies is repeated by the next one under its number.
    """
    scratch = scratch or Scratch(spark, "changes")
    book = Ledger(spark, ledger)
    run = book.run()
    fates = scratch.spool(book.fates(listing(spark, folder, pattern, recursive, scratch), retry))
    todo = fates.where(F.col("fate").isin(NEW, REWRITTEN, RETRIED)).select("path", "modificationTime", "length")
    raw = contents(todo).withColumn("rel_path", relative_path(F.col("path"), qualified(spark, folder)))
    step(raw).write.mode("overwrite").parquet(f"{out.rstrip('/')}/run={run}")
    rows = spark.read.parquet(f"{out.rstrip('/')}/run={run}")
    done = rows.groupBy("path").agg(F.max("error").alias("new_error"), F.lit(True).alias("done"))
    joined = fates.join(done, "path", "left")
    taken = F.col("fate").isin(NEW, REWRITTEN, RETRIED)
    made = F.when(F.col("done").isNull(), "rejected").when(F.col("new_error").isNotNull(), "failed").otherwise("converted")
    after = scratch.spool(
        joined.select(
            "path", "modificationTime", "length", "fate",
            F.when(taken, made).otherwise(F.col("old_outcome")).alias("outcome"),
            F.when(taken, F.col("new_error")).otherwise(F.col("old_error")).alias("error"),
            F.when(taken, F.lit(run).cast("long")).otherwise(F.col("old_run")).alias("run"),
        )
    )
    book.commit(after.where("fate <> 'deleted'"), run)
    return after.select("path", "fate", "outcome", "error")


def current_corpus(spark: SparkSession, out: str, ledger: str) -> DataFrame:
    """The rows of ``out`` that stand: for each file of the ledger those of the run that took it last."""
    state = Ledger(spark, ledger).state().select("path", "run")
    return spark.read.option("basePath", out).parquet(out).withColumn("run", F.col("run").cast("long")).join(state, ["path", "run"]).drop("run")
