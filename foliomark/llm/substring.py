"""Repeated passages: windows of words counted exactly in super-k-mer buckets.

The minimiser of a window is its least hash of ``gram`` words. Consecutive windows with one minimiser
travel as one string, a super-k-mer, to the bucket of that minimiser; equal windows have equal
minimisers, so each bucket counts its windows on its own.

1. A first reading counts anchors. The anchor of a window is the longer run of words at its minimiser:
   those up to it where it lies in the window's second half, else those from it on. Equal windows have equal
   anchors at different places, so a window whose anchor has one place occurs once. Only windows of repeated
   anchors travel, as words that meet by chance are rarely that many; a bit table of fixed size tells them.
2. A second reading writes documents without such windows as done, the others with their words.
3. Equal super-k-mers are counted before they travel, so copies of a passage are one row.
4. A bucket sorts its windows and compares neighbours word by word. Minimisers with more than
   ``bucket_windows`` windows in different super-k-mers send their windows apart instead, as digests
   that Spark sums like any other key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomark.llm.bits import bit_table, contains
from foliomark.llm.tables import map_batches, numbered, table
from foliomark.llm.words import SPACED, byte_values, mixed, ragged, run_hashes, signed, slices, text_bytes, word_hashes, word_spans
from foliomark.operators.spool import Scratch

WINDOW = 35
GRAM = 8
LONGEST = 64
BUCKET_WINDOWS = 200_000
FLUSH_WINDOWS = 50_000


def _sliding(values: np.ndarray, width: int, best: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The ``best`` of each ``width`` consecutive values; of two, the first argument lies first."""
    have, out = 1, values
    while have < width:
        step = min(have, width - have)
        out = best(out[:-step], out[step:]) if len(out) > step else out[:0]
        have += step
    return out


class Windows:
    """The windows of some texts: which are inside one text, their minimisers and anchors, and the words of each text."""

    def __init__(self, texts: pa.Array, window: int, gram: int, values: np.ndarray) -> None:
        raw, offsets = text_bytes(texts)
        starts, ends, self.begins = word_spans(raw, offsets, SPACED)
        self.sizes = np.diff(self.begins)
        self.gram, self.width = gram, window - gram + 1
        self.grams = grams = run_hashes(word_hashes(raw, starts, ends, values), gram)
        # the first place of the least hash, so that it lies at the same place in equal windows
        place = _sliding(np.arange(len(grams)), self.width, lambda a, b: np.where(grams[b] < grams[a], b, a))
        self.least = grams[place]
        n = len(self.least)
        self.valid = np.arange(n) + window <= np.repeat(self.begins[1:], self.sizes)[:n]
        self.half = self.width // 2
        self.anchor = place - np.where(place - np.arange(n) >= self.half, self.half, 0)
        starts_one = np.zeros(len(grams), dtype=bool)
        starts_one[self.anchor[self.valid]] = True
        self.places = np.flatnonzero(starts_one)

    def anchors(self) -> np.ndarray:
        """The hash of the ``half + gram`` words at every place that is the anchor of some window, each place once."""
        total = np.zeros(len(self.places), dtype=np.uint64)
        for step in (*range(0, self.half, self.gram), self.half):
            total = mixed(total) + self.grams[self.places + step]
        return mixed(total)

    def super_kmers(self, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, start, windows, minimiser) of all super-k-mers of the windows whose anchor is ``repeated``.

        ``repeated``: a flag for each of ``anchors()``. A super-k-mer has ``LONGEST`` windows at most.
        """
        flags = np.zeros(len(self.grams), dtype=bool)
        flags[self.places] = repeated
        least, valid = self.least, self.valid & flags[self.anchor]
        fresh = valid.copy()
        fresh[1:] &= ~valid[:-1] | (least[1:] != least[:-1])
        goes_on = np.zeros(len(least), dtype=bool)
        goes_on[:-1] = valid[1:] & ~fresh[1:]
        first, stop = np.flatnonzero(fresh), np.flatnonzero(valid & ~goes_on) + 1
        count = -(-(stop - first) // LONGEST)
        at = np.repeat(first, count) + ragged(np.zeros(len(first), np.int64), count) * LONGEST
        length = np.minimum(np.repeat(stop, count) - at, LONGEST)
        row = np.searchsorted(self.begins, at, side="right") - 1
        return row, at - self.begins[row], length, least[at]


def anchors(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(anchor, n): places of anchors by hash, summed per slice."""

    def step():  # noqa: ANN202
        values = byte_values(lower=False)

        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for part in slices(batch):
                found, n = np.unique(Windows(part.column("text"), window, gram, values).anchors(), return_counts=True)
                yield pa.record_batch({"anchor": pa.array(signed(found)), "n": pa.array(n, pa.int64())})

        return each

    return map_batches(docs.select("text"), step, "anchor long, n long")


def _joined(text: bytes) -> bytes:
    return b" ".join(text.split())  # bytes.split() cuts at the same six white space characters


def candidates(docs: DataFrame, repeated: Broadcast, window: int, gram: int) -> DataFrame:
    """Per document its super-k-mers of repeated anchors and its words; without any, the result."""

    def step():  # noqa: ANN202
        values, bits = byte_values(lower=False), repeated.value
        kmer = pa.struct([("start", pa.int64()), ("windows", pa.int32()), ("minimiser", pa.int64())])

        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for part in slices(batch):
                windows = Windows(part.column("text"), window, gram, values)
                row, start, length, least = windows.super_kmers(contains(bits, windows.anchors()))
                cuts = np.searchsorted(row, np.arange(part.num_rows + 1))
                kmers = pa.StructArray.from_arrays(
                    [pa.array(start, pa.int64()), pa.array(length, pa.int32()), pa.array(signed(least))], fields=list(kmer)
                )
                words, digests = [], []
                for i, text in enumerate(part.column("text").to_pylist()):
                    whole = _joined((text or "").encode())
                    none = cuts[i] == cuts[i + 1]
                    words.append(None if none else whole.decode())
                    digests.append(hashlib.sha256(whole).hexdigest() if none else None)
                yield pa.record_batch(
                    {
                        "row_id": part.column("row_id"),
                        "doc_id": part.column("doc_id"),
                        "n_words": pa.array(windows.sizes, pa.int64()),
                        "words": pa.array(words, pa.string()),
                        "kept_sha256": pa.array(digests, pa.string()),
                        "kmers": pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), kmers),
                    }
                )

        return each

    kind = dict(docs.dtypes)["doc_id"]
    kmers = "array<struct<start:long,windows:int,minimiser:long>>"
    return map_batches(docs, step, f"row_id long, doc_id {kind}, n_words long, words string, kept_sha256 string, kmers {kmers}")


def travelling(read: DataFrame, window: int, with_text: bool) -> DataFrame:
    """(row_id, start, windows, minimiser, key[, packed]): one row per super-k-mer, its words as one string."""

    def rows_of(row: dict) -> pa.RecordBatch:
        text, kmers = row["words"].encode(), row["kmers"]
        begins = np.concatenate([[0], np.flatnonzero(np.frombuffer(text, np.uint8) == 32) + 1, [len(text) + 1]]).tolist()
        packed = [text[begins[k["start"]] : begins[k["start"] + k["windows"] + window - 1] - 1] for k in kmers]
        out = {
            "row_id": pa.array([row["row_id"]] * len(kmers), pa.int64()),
            "start": pa.array([k["start"] for k in kmers], pa.int64()),
            "windows": pa.array([k["windows"] for k in kmers], pa.int32()),
            "minimiser": pa.array([k["minimiser"] for k in kmers], pa.int64()),
            "key": pa.array([hashlib.blake2b(p, digest_size=16).digest() for p in packed], pa.binary()),
        }
        if with_text:
            out["packed"] = pa.array(packed, pa.binary()).cast(pa.string())
        return pa.record_batch(out)

    def step():  # noqa: ANN202
        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for part in slices(batch, "words"):
                for row in part.to_pylist():
                    yield rows_of(row)

        return each

    schema = "row_id long, start long, windows int, minimiser long, key binary" + ", packed string" * with_text
    return map_batches(read.filter("words is not null").select("row_id", "words", "kmers"), step, schema)


def _codes(packed: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The words of all strings as numbers, equal exactly for equal words, and the begin of each string's."""
    lists = [p.split(" ") for p in packed]
    words = pa.array([w for some in lists for w in some], pa.large_string()).dictionary_encode()
    begins = np.concatenate([[0], np.cumsum([len(some) for some in lists])])
    return words.indices.to_numpy(zero_copy_only=False).astype(np.int32), begins


def _repeated(packed: list[str], windows: np.ndarray, times: np.ndarray, window: int) -> np.ndarray:
    """For the windows of all strings, one after the other: do they occur more than once?"""
    codes, begins = _codes(packed)
    at = ragged(begins[:-1], windows)
    weight = np.repeat(times, windows)
    view = np.lib.stride_tricks.sliding_window_view(codes, window)
    hashes = run_hashes(mixed(codes.astype(np.uint64) + np.uint64(1)), window)[at]
    order = np.argsort(hashes, kind="stable")
    same = np.empty(len(order), dtype=bool)
    same[:1] = False
    same[1:] = hashes[order[1:]] == hashes[order[:-1]]
    near = np.flatnonzero(same)
    if not (view[at[order[near]]] == view[at[order[near - 1]]]).all():
        # two different windows share a hash: sort by all their words instead
        rows = view[at]
        order = np.lexsort(rows.T[::-1])
        same[1:] = (rows[order[1:]] == rows[order[:-1]]).all(axis=1)
    group = np.cumsum(~same) - 1
    total = np.bincount(group, weights=weight[order])
    out = np.empty(len(order), dtype=bool)
    out[order] = total[group] > 1
    return out


def _ranges(flags: np.ndarray) -> list[dict]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [{"first": int(a), "last": int(b)} for a, b in zip(edges[::2], edges[1::2], strict=True)]


def counted_in_buckets(distinct: DataFrame, window: int) -> DataFrame:
    """(key, repeated): ranges of repeated windows of each super-k-mer; whole minimisers are sorted together."""
    range_type = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))

    def done(rows: list[dict]) -> pa.RecordBatch:
        windows = np.array([r["windows"] for r in rows], dtype=np.int64)
        flags = _repeated([r["packed"] for r in rows], windows, np.array([r["n"] for r in rows], dtype=np.int64), window)
        ends = np.cumsum(windows)
        found = [(r["key"], _ranges(flags[b - w : b])) for r, w, b in zip(rows, windows, ends, strict=True)]
        found = [(k, x) for k, x in found if x]
        return pa.record_batch({"key": pa.array([k for k, _ in found], pa.binary()), "repeated": pa.array([x for _, x in found], range_type)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        total = 0
        for batch in batches:
            for row in batch.to_pylist():
                if total >= FLUSH_WINDOWS and row["minimiser"] != rows[-1]["minimiser"]:
                    yield done(rows)
                    rows, total = [], 0
                rows.append(row)
                total += row["windows"]
        if rows:
            yield done(rows)

    sorted_rows = distinct.repartition("minimiser").sortWithinPartitions("minimiser")
    return sorted_rows.mapInArrow(run, "key binary, repeated array<struct<first:int,last:int>>")


def counted_apart(distinct: DataFrame, window: int) -> DataFrame:
    """The same for minimisers too frequent for one bucket: their windows are rows, summed by digest."""

    def step():  # noqa: ANN202
        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for row in batch.to_pylist():
                words = row["packed"].encode().split(b" ")
                digests = [hashlib.blake2b(b" ".join(words[k : k + window]), digest_size=16).digest() for k in range(row["windows"])]
                yield pa.record_batch(
                    {
                        "key": pa.array([row["key"]] * len(digests), pa.binary()),
                        "k": pa.array(range(len(digests)), pa.int32()),
                        "window": pa.array(digests, pa.binary()),
                        "n": pa.array([row["n"]] * len(digests), pa.int64()),
                    }
                )

        return each

    each = map_batches(distinct, step, "key binary, k int, window binary, n long")
    often = each.groupBy("window").agg(F.sum("n").alias("total")).filter("total > 1").select("window")
    one = F.transform(F.array_sort(F.collect_set("k")), lambda k: F.struct(k.alias("first"), (k + 1).alias("last")))
    return each.join(often, "window").groupBy("key").agg(one.alias("repeated"))


def _removed(read: DataFrame, marks: DataFrame, window: int) -> DataFrame:
    """Results of the documents that have words to look at."""

    def step():  # noqa: ANN202
        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for part in slices(batch, "words"):
                removed, digests = [], []
                for row in part.select(["words", "marks"]).to_pylist():
                    words = row["words"].encode().split(b" ")
                    change = np.zeros(len(words) + 1, dtype=np.int64)
                    for mark in row["marks"] or ():
                        for r in mark["repeated"]:
                            # windows first..last-1 cover words up to last - 1 + window - 1
                            change[mark["start"] + r["first"]] += 1
                            change[mark["start"] + r["last"] + window - 1] -= 1
                    gone = np.cumsum(change)[:-1] > 0
                    removed.append(int(gone.sum()))
                    digests.append(hashlib.sha256(b" ".join([words[i] for i in np.flatnonzero(~gone)])).hexdigest())
                yield pa.record_batch(
                    {
                        "doc_id": part.column("doc_id"),
                        "n_words": part.column("n_words"),
                        "n_removed": pa.array(removed, pa.int64()),
                        "kept_sha256": pa.array(digests),
                    }
                )

        return each

    kind = dict(read.dtypes)["doc_id"]
    rows = read.filter("words is not null").select("row_id", "doc_id", "n_words", "words").join(marks, "row_id", "left")
    return map_batches(rows, step, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, bucket_windows: int = BUCKET_WINDOWS) -> DataFrame:
    """Words that lie in a window which occurs more than once, in one text or several, are removed.

    ``docs(doc_id, text, ...)`` -> (doc_id, n_words, n_removed, kept_sha256), one row per row; other
    columns are left out. Null and empty texts have no words. Repeated rows are copies of each other
    and lose all words in windows, the first one too: windows are judged on the input. Texts of
    fewer words than a window keep all of them.
    """
    scratch = Scratch(docs.sparkSession, "substring")
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    often = anchors(rows, window, gram).groupBy("anchor").agg(F.sum("n").alias("n")).filter("n > 1")
    repeated = bit_table(often.select("anchor"), "anchor")
    read = scratch.spool(candidates(numbered(rows), repeated, window, gram))
    packed = travelling(read, window, with_text=True)
    distinct = scratch.spool(packed.groupBy("minimiser", "key", "windows", "packed").agg(F.count("*").alias("n")))
    hot = distinct.groupBy("minimiser").agg(F.sum("windows").alias("total")).filter(F.col("total") > bucket_windows).select("minimiser")
    hot = scratch.spool(hot)
    usual = counted_in_buckets(distinct.join(hot, "minimiser", "left_anti"), window)
    found = scratch.spool(usual.union(counted_apart(distinct.join(hot, "minimiser", "left_semi"), window)))
    scratch.drop(distinct)
    marks = (
        travelling(read, window, with_text=False)
        .select("row_id", "start", "key")
        .join(found, "key")
        .groupBy("row_id")
        .agg(F.collect_list(F.struct("start", "repeated")).alias("marks"))
    )
    whole = read.filter("words is null").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256")
    return whole.union(_removed(read, marks, window))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of whole documents outside windows of 35 words that repeat."""
    return remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))


def op5_sql() -> str:
    return r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
w AS (SELECT doc_id, k, md5(array_to_string(ws[k:k + 34], ' ')) AS win
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS k FROM d WHERE len(ws) >= 35)),
r AS (SELECT doc_id, k FROM w WHERE win IN (SELECT win FROM w GROUP BY win HAVING count(*) > 1)),
g AS (SELECT DISTINCT doc_id, unnest(range(k, k + 35)) AS p FROM r),
p AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM p ANTI JOIN g USING (doc_id, p) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
"""
