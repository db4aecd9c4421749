"""Packing: first-fit decreasing by a tournament tree of bin capacities, in randomised groups.

Every text is encoded and cut at multiples of the sequence length, so that only its last piece is
shorter. Pieces get a random number when they are written; groups of about ``group`` pieces by that
number are packed each on its own, so no key of the data decides who meets whom.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomark.llm.encoder import WordEncoder
from foliomark.llm.tables import map_batches, table
from foliomark.llm.words import SLICE_BYTES, slices
from foliomark.operators.spool import Scratch

SEQUENCE = 4096
GROUP = 16_384
END_ID = 2
SEED = 20_260
SLICE = 1 << 20
BIN_BITS = 24

PIECE = "start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, path: str, length: int = SEQUENCE, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids]): the ids of each text and ``end_id``, cut every ``length``.

    Null and empty texts are the end id alone. Repeated rows and null ids: each row is its own text.
    """

    def step():  # noqa: ANN202
        encoder = WordEncoder(path)

        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for part in slices(batch, limit=SLICE):
                flat, begins = encoder.encode(part.column("text"))
                sizes = np.diff(begins) + 1
                count = -(-sizes // length)
                rows = np.repeat(np.arange(len(sizes)), count)
                nth = np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count)
                starts = nth * length
                lengths = np.minimum(sizes[rows] - starts, length)
                ids = np.insert(flat, begins[1:], end_id).astype("<u4", copy=False)
                del flat
                first = begins[:-1][rows] + rows + starts
                view = memoryview(ids).cast("B")
                spans = list(zip((first * 4).tolist(), ((first + lengths) * 4).tolist(), strict=True))
                out = {
                    "doc_id": part.column("doc_id").take(pa.array(rows)),
                    "start": pa.array(starts, pa.int64()),
                    "length": pa.array(lengths, pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(view[a:b]) for a, b in spans], pa.int64()),
                    "doc_tokens": pa.array(sizes[rows], pa.int64()),
                }
                if keep_ids:
                    cuts = np.concatenate([first, [len(ids)]]).astype(np.int32)
                    out["ids"] = pa.ListArray.from_arrays(pa.array(cuts), pa.array(ids.view(np.int32)))
                yield pa.record_batch(out)

        return each

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, {PIECE}" + ", ids array<int>" * keep_ids
    return map_batches(docs.select("doc_id", F.col("text").cast("string").alias("text")), step, schema)


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length; ties go by position.

    The leaves of the tree are bins, each node holds the most room below it, so the first bin with
    enough room is found on one path down.
    """
    n = len(lengths)
    bins, offsets = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    leaves = 1 << max(0, n - 1).bit_length()
    room = [capacity] * (2 * leaves)
    for i in np.argsort(-lengths, kind="stable").tolist():
        size, node = int(lengths[i]), 1
        while node < leaves:
            node *= 2
            if room[node] < size:
                node += 1
        bins[i], offsets[i] = node - leaves, capacity - room[node]
        room[node] -= size
        while node > 1:
            node //= 2
            best = max(room[2 * node], room[2 * node + 1])
            if room[node] == best:
                break
            room[node] = best
    return bins, offsets


def pack(cut: DataFrame, length: int = SEQUENCE, group: int = GROUP, seed: int = SEED) -> DataFrame:
    """``cut``: pieces of at most ``length`` -> the same with sequence_id and offset.

    The pieces are written once with their random numbers, so a repeated task packs the same again;
    while they are made, Python gets texts of about 4 MB at once.
    Columns of ``cut`` other than doc_id and those of a piece stay, also ids. Empty: empty.
    """
    scratch = Scratch(cut.sparkSession, "packing")
    kept = scratch.spool(cut.withColumn("__draw", F.rand(seed)), batch_bytes=SLICE_BYTES)
    groups = max(1, -(-kept.count() // group))

    def each(some: pd.DataFrame) -> pd.DataFrame:
        some = some.sort_values("__draw", ignore_index=True)
        bins, offsets = first_fit_decreasing(some["length"].to_numpy(), length)
        number = int(some["__group"].iloc[0])
        return some.drop(columns=["__draw", "__group"]).assign(sequence_id=(number << BIN_BITS) + bins, offset=offsets)

    fields = ", ".join(f"`{name}` {kind}" for name, kind in cut.dtypes)
    dealt = kept.withColumn("__group", F.floor(F.col("__draw") * groups).cast("long"))
    return dealt.groupBy("__group").applyInPandas(each, f"{fields}, sequence_id long, offset long")


def packed(docs: DataFrame, path: str, length: int = SEQUENCE, keep_ids: bool = False) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> one row per piece with its place in a sequence; other columns are left out."""
    return pack(pieces(docs, path, length, keep_ids=keep_ids), length)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 ids of word_bpe_49k.json."""
    import public_tokenizers

    return packed(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
