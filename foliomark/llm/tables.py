"""Tables and small helpers the operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def give_back() -> None:
    """Free memory of this process goes back to the system; Spark's Python workers live on after their task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:  # glibc has it
        trim(0)


def map_batches(df: DataFrame, step: Callable[[], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]], schema: str) -> DataFrame:
    """``mapInArrow`` with what ``step()`` sets up once for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = step()
        for batch in batches:
            if batch.num_rows:
                yield from each(batch)
        del each
        give_back()

    return df.mapInArrow(run, schema)


def numbered(df: DataFrame, name: str = "row_id") -> DataFrame:
    """A number for each row that ids cannot give: ids may repeat or be null. Write before reuse."""
    return df.withColumn(name, F.monotonically_increasing_id())


def components(scratch, links: DataFrame) -> DataFrame:  # noqa: ANN001 - a Scratch
    """Smallest member of the component of every node in ``links(a long, b long)``: (node, root).

    Large-star and small-star steps, each a minimum per node and a join, until nothing changes.
    Minima combine before the shuffle, and a node with very many links is only a skewed join key.
    Each round is written to the shared folder and checked by its count and a sum over its rows.
    """
    edges = scratch.spool(
        links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    seen = None
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        below = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(below, "u")
        small = (
            joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(below.select("u", F.col("m").alias("v")))
        )
        after = scratch.spool(small.distinct())
        total = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        state = tuple(after.agg(F.count("*"), total).first())
        scratch.drop(edges)
        edges = after
        if state == seen:
            break
        seen = state
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return nodes.union(roots)


def map_groups(df: DataFrame, key: str, step: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``step`` on tables that hold all rows of some values of the long column ``key``, sorted by it.

    Groups have to be bounded by the caller; many small ones share one call.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(key).to_numpy(zero_copy_only=False)
            # rows of the batch's last key wait for the next batch
            cut = int(np.searchsorted(keys, keys[-1], side="left"))
            if cut or (held and held[-1].column(key)[-1].as_py() != keys[0]):
                whole = pa.Table.from_batches([*held, batch.slice(0, cut)])
                held = []
                if whole.num_rows:
                    yield from step(whole.combine_chunks())
            held.append(batch.slice(cut))
        if held:
            yield from step(pa.Table.from_batches(held).combine_chunks())
        held = []
        give_back()

    return df.repartition(key).sortWithinPartitions(key).mapInArrow(run, schema)


def group_bounds(keys: np.ndarray) -> np.ndarray:
    """Where each group of equal neighbouring keys begins, and the end."""
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
