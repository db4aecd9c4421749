"""Listings of folders made by tasks, and the contents of what they list.

The frontier of the walk is a table of folders. A task lists its folders and goes on into their
subfolders until it has seen ``BUDGET`` entries; folders it has not reached then are the next round's
frontier. So a wide tree is spread over tasks, a deep one does not need a round per level, and no list
of paths ever is in the driver. Every name counts, those that begin with ``_`` or ``.`` too.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomark.operators.spool import Scratch
from foliomark.sources.stores import Stores, exists, qualified

BUDGET = 10_000
BATCH_ROWS = 4_096
# Input bytes after which a reading task hands on what it has, and those it should get in all.
BATCH_BYTES = 8 << 20
TASK_BYTES = 128 << 20

ENTRY = pa.schema([("path", pa.string()), ("modificationTime", pa.timestamp("us", "UTC")), ("length", pa.int64()), ("is_folder", pa.bool_())])
_ENTRY = "path string, modificationTime timestamp, length long, is_folder boolean"


def name_pattern(glob: str) -> str:
    """The regular expression of a file name glob: ``* ? [ab] [!a-c] {x,y}`` and backslash."""
    out, at, depth = [], 0, 0
    while at < len(glob):
        c = glob[at]
        at += 1
        if c == "\\" and at < len(glob):
            out.append(re.escape(glob[at]))
            at += 1
        elif c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        elif c == "[" and (end := glob.find("]", at + 2 if glob[at : at + 1] in ("!", "^") else at + 1)) > 0:
            inner = glob[at:end]
            negated = inner[:1] in ("!", "^")
            body = re.sub(r"([\\\[\]^&~|])", r"\\\1", inner[1:] if negated else inner)
            out.append(f"[{'^' if negated else ''}{body}]")
            at = end + 1
        else:
            out.append(re.escape(c))
    if depth:
        raise ValueError(f"a brace stays open in {glob!r}")
    return "".join(out)


def _walk(frontier: DataFrame, pattern: str, recursive: bool, budget: int) -> DataFrame:
    """Files of the frontier's folders that fit, and the folders that wait for the next round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stores, fits, rows = Stores(), re.compile(pattern, re.DOTALL), []
        for batch in batches:
            for begin in batch.column("folder").to_pylist():
                waiting, seen = [begin], 0
                while waiting and seen < budget:
                    for path, changed, length, is_folder in stores.entries(waiting.pop()):
                        seen += 1
                        if is_folder and recursive and len(waiting) < budget:
                            waiting.append(path)
                        elif is_folder and recursive or not is_folder and fits.fullmatch(path.rpartition("/")[2]):
                            rows.append((path, changed, length, is_folder))
                        if len(rows) >= BATCH_ROWS:
                            yield _entries(rows)
                            rows = []
                rows += [(path, None, None, True) for path in waiting]
        yield _entries(rows)

    return frontier.mapInArrow(run, _ENTRY)


def _entries(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[k] for r in rows], ENTRY.field(k).type) for k in range(len(ENTRY))], schema=ENTRY)


def listing(
    spark: SparkSession, folder: str, pattern: str = "*", recursive: bool = False, scratch: Scratch | None = None, budget: int = BUDGET
) -> DataFrame:
    """``path, modificationTime, length`` of the files in a folder, at any depth with ``recursive``.

    A missing folder is an error at once; one that disappears while the walk is on is empty. Links to
    folders are not followed, so no file is listed twice; links to files are files. The listing is
    written once and belongs to ``scratch``.
    """
    root = qualified(spark, folder)
    if not exists(spark, folder):
        raise AnalysisException(f"[PATH_NOT_FOUND] Path does not exist: {root}.")
    scratch = scratch or Scratch(spark, "listing")
    fits = name_pattern(pattern)
    frontier = spark.createDataFrame([(root,)], "folder string")
    rounds = []
    while True:
        found = scratch.spool(_walk(frontier, fits, recursive, budget))
        rounds.append(found)
        folders = found.where("is_folder").select(F.col("path").alias("folder"))
        waiting = folders.count()
        if not waiting:
            break
        tasks = min(waiting, 4 * spark.sparkContext.defaultParallelism)
        frontier = folders.repartition(tasks, "folder")
    return reduce(DataFrame.unionAll, rounds).where("NOT is_folder").select("path", "modificationTime", "length")


def contents(listed: DataFrame) -> DataFrame:
    """The listed files with their ``content``; null for a file that is gone by now.

    Read by tasks, about 128 MB each. Other columns of the listing stay.
    """
    spark = listed.sparkSession
    total, n = listed.agg(F.coalesce(F.sum("length"), F.lit(0)), F.count(F.lit(1))).first()
    least = min(n, spark.sparkContext.defaultParallelism)
    tasks = max(1, least, math.ceil(total / TASK_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stores = Stores()
        for batch in batches:
            held, size, begin = [], 0, 0
            for k, path in enumerate(batch.column("path").to_pylist()):
                try:
                    held.append(stores.read(path))
                except FileNotFoundError:
                    held.append(None)
                size += len(held[-1] or b"")
                if size >= BATCH_BYTES or k + 1 == batch.num_rows:
                    part = batch.slice(begin, len(held))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(held, pa.binary())], names=[*batch.schema.names, "content"])
                    held, size, begin = [], 0, k + 1

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in listed.schema.fields)
    return listed.repartition(tasks, "path").mapInArrow(run, f"{fields}, content binary")
