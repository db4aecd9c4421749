"""Benchmark passages in documents: a prefix-filtered join of shingle sets, verified on the words.

Each item is cut into windows of ``window`` words (one shorter window, if it has fewer words), and a
window is the set of its shingles of five words. A window is only contained if all its shingles are,
so one of them is its necessary prefix: the one that is rarest in the documents.

1. The documents are read once. Shingles that some window has are found by a bit table of fixed size;
   words covered by them without a gap form a run. Runs shorter than the shortest window are left out,
   long ones are cut into pieces that overlap by a window less a word, so every window lies in one.
2. Equal pieces are joined once, however many documents hold them.
3. Shingle counts over all documents order the shingles of each window. Windows with a shingle that
   no document has are gone; the others join by their rarest shingle.
4. Its positions in run and window fix where the window would lie; it has to lie inside the run, and
   its words have to be equal.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomark.llm.bits import bit_table, contains
from foliomark.llm.tables import map_batches, numbered, table
from foliomark.llm.words import (
    ALNUM,
    SLICE_BYTES,
    byte_values,
    lowered,
    mixed,
    run_hashes,
    signed,
    slices,
    text_bytes,
    word_hashes,
    word_spans,
)
from foliomark.operators.spool import Scratch

WINDOW = 10
SHINGLE = 5
#: words after which a run is cut; the next piece begins there, and a piece goes on for a window less a word
PIECE = 32


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    raw, offsets = text_bytes(texts)
    low = lowered(raw)
    return low, *word_spans(low, offsets, ALNUM)


def _shingles(hashes: np.ndarray, begins: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the shingles of ``size`` words inside one text."""
    ends = np.repeat(begins[1:], np.diff(begins))
    found = mixed(run_hashes(hashes, size) ^ np.uint64(size))
    inside = np.flatnonzero(np.arange(len(found)) + size <= ends[: len(found)])
    return inside, found[inside]


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """(item_id, words, size): every ``window`` consecutive words of an item, or all of a shorter one."""

    def step():  # noqa: ANN202
        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for part in slices(batch):
                low, starts, ends, begins = _words(part.column("text"))
                rows, texts, sizes = [], [], []
                for i in range(part.num_rows):
                    words = [low[a:b].tobytes() for a, b in zip(starts[begins[i] : begins[i + 1]], ends[begins[i] : begins[i + 1]], strict=True)]
                    size = min(window, len(words))
                    some = {b" ".join(words[k : k + size]) for k in range(len(words) - size + 1)} if size else ()
                    texts += some
                    rows += [i] * len(some)
                    sizes += [size] * len(some)
                yield pa.record_batch(
                    {
                        "item_id": part.column("item_id").take(pa.array(rows, pa.int64())),
                        "words": pa.array(texts, pa.binary()).cast(pa.string()),
                        "size": pa.array(sizes, pa.int32()),
                    }
                )

        return each

    kind = dict(items.dtypes)["item_id"]
    return map_batches(items, step, f"item_id {kind}, words string, size int")


def shingled(texts: DataFrame, sizes: list[int]) -> DataFrame:
    """(words, at, shingle) for a ``words`` column, for each size of shingles."""

    def step():  # noqa: ANN202
        values = byte_values(lower=False)

        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for part in slices(batch, "words"):
                low, starts, ends, begins = _words(part.column("words"))
                hashes = word_hashes(low, starts, ends, values)
                for size in sizes:
                    at, found = _shingles(hashes, begins, size)
                    row = np.searchsorted(begins, at, side="right") - 1
                    yield pa.record_batch(
                        {
                            "words": part.column("words").take(pa.array(row)),
                            "at": pa.array(at - begins[row], pa.int32()),
                            "shingle": pa.array(signed(found)),
                        }
                    )

        return each

    return map_batches(texts.select("words"), step, "words string, at int, shingle long")


def covered_runs(docs: DataFrame, known: Broadcast, sizes: list[int], shortest: int, longest: int) -> DataFrame:
    """Each document with its number of words and the pieces of its runs of words covered by known shingles."""

    def step():  # noqa: ANN202
        values, bits = byte_values(lower=False), known.value
        run = pa.struct([("at", pa.int64()), ("words", pa.string())])

        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for part in slices(batch):
                low, starts, ends, begins = _words(part.column("text"))
                hashes = word_hashes(low, starts, ends, values)
                change = np.zeros(len(hashes) + 1, dtype=np.int64)
                for size in sizes:
                    at, found = _shingles(hashes, begins, size)
                    at = at[contains(bits, found)]
                    np.add.at(change, at, 1)
                    np.add.at(change, at + size, -1)
                inside = np.concatenate([[False], np.cumsum(change)[:-1] > 0, [False]])
                # a run ends with its text: nothing covers words of two texts, but two runs may touch there
                first = np.flatnonzero(inside[1:-1] & ~inside[:-2])
                last = np.flatnonzero(inside[1:-1] & ~inside[2:]) + 1
                touch = begins[1:-1][(begins[1:-1] > 0) & (begins[1:-1] < len(hashes))]
                touch = np.unique(touch[inside[touch] & inside[touch + 1]])
                first, last = np.union1d(first, touch), np.union1d(last, touch)
                # pieces of each run: one begins every PIECE words, and reaches as far as its last window can
                many = -(-(last - first) // PIECE)
                end = np.repeat(last, many)
                first = ragged_steps(first, many)
                last = np.minimum(first + PIECE + longest - 1, end)
                long = last - first >= shortest
                runs: list[list[dict]] = [[] for _ in range(part.num_rows)]
                for a, b in zip(first[long].tolist(), last[long].tolist(), strict=True):
                    i = int(np.searchsorted(begins, a, side="right")) - 1
                    words = b" ".join(low[x:y].tobytes() for x, y in zip(starts[a:b], ends[a:b], strict=True))
                    runs[i].append({"at": a - int(begins[i]), "words": words.decode()})
                yield pa.record_batch(
                    {
                        "row_id": part.column("row_id"),
                        "doc_id": part.column("doc_id"),
                        "n_words": pa.array(np.diff(begins), pa.int64()),
                        "runs": pa.array(runs, pa.list_(run)),
                    }
                )

        return each

    kind = dict(docs.dtypes)["doc_id"]
    return map_batches(docs, step, f"row_id long, doc_id {kind}, n_words long, runs array<struct<at:long,words:string>>")


def ragged_steps(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Begin of each piece: ``first``, ``first + PIECE``, ... of each run."""
    at = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    return np.repeat(first, many) + at * PIECE


def _joined_spans(hits: DataFrame) -> DataFrame:
    """(row_id, spans, items) with spans of different pieces joined where they meet; linear in the spans."""

    def step():  # noqa: ANN202
        span = pa.struct([("first", pa.int64()), ("last", pa.int64())])

        def merged(spans: list[dict]) -> list[dict]:
            out: list[dict] = []
            for s in sorted(spans, key=lambda s: s["first"]):
                if out and s["first"] <= out[-1]["last"]:
                    out[-1]["last"] = max(out[-1]["last"], s["last"])
                else:
                    out.append(dict(s))
            return out

        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            spans = pa.array([merged(x) for x in batch.column("spans").to_pylist()], pa.list_(span))
            yield pa.record_batch({"row_id": batch.column("row_id"), "spans": spans, "items": batch.column("items")})

        return each

    return map_batches(hits, step, f"row_id long, spans array<struct<first:long,last:long>>, items {dict(hits.dtypes)['items']}")


def _merged(spans: Column) -> Column:
    """Sorted disjoint (first, last) spans, ends exclusive, of spans that may overlap."""
    empty = F.array().cast("array<struct<first:long,last:long>>")

    def add(done: Column, s: Column) -> Column:
        top = F.get(done, F.size(done) - 1)
        grown = F.struct(top["first"].alias("first"), F.greatest(top["last"], s["last"]).alias("last"))
        joined = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(grown))
        return F.when(F.coalesce(top["last"] >= s["first"], F.lit(False)), joined).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(F.array_sort(spans), empty, add)


def contained_items(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, row_id: str | None = None
) -> DataFrame:
    """Which words of each document lie in a window of an item, and which items have such windows.

    ``docs(doc_id, text, ...)``, ``items(item_id, text, ...)`` -> (row_id, doc_id, n_words, n_hit, spans,
    item_ids), one row per row of docs; other columns are left out. ``row_id``: a long column of
    ``docs`` that numbers its rows, made here if not given. Null or empty text has no words
    and gets zeros and empty arrays. Items without words match nothing; rows of one item_id count
    as one item, and rows without item_id mark words but count as none.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontaminate")
    items = items.select("item_id", F.col("text").cast("string").alias("text"))
    windows = scratch.spool(item_windows(items, window))
    sizes = sorted({min(shingle, r["size"]) for r in windows.select("size").distinct().collect()})
    shortest, longest = (x or window for x in windows.agg(F.min("size"), F.max("size")).first())
    own = scratch.spool(_own_shingles(windows.select("words", "size").distinct(), sizes, shingle))
    known = bit_table(own.select("shingle"), "shingle")
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), *([F.col(row_id).alias("row_id")] if row_id else []))
    rows = rows if row_id else numbered(rows)
    read = scratch.spool(covered_runs(rows, known, sizes, shortest, longest), batch_bytes=SLICE_BYTES)
    runs = read.select("row_id", F.explode("runs").alias("run")).select("row_id", "run.at", "run.words")
    # equal pieces once, with the number of their occurrences
    once = scratch.spool(runs.groupBy("words").agg(F.count("*").alias("n")))
    inside = scratch.spool(shingled(once, sizes))
    counts = inside.join(once, "words").groupBy("shingle").agg(F.sum("n").alias("n"))
    # each window's rarest shingle; a window with a shingle that is nowhere occurs nowhere
    prefix = (
        own.join(counts, "shingle", "left")
        .groupBy("words", "size")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle", "at")).alias("rarest"))
        .filter("rarest.n > 0")
        .select(F.col("words").alias("window"), "size", F.col("rarest.shingle").alias("shingle"), F.col("rarest.at").alias("window_at"))
    )
    # conditions may be evaluated in any order, so each is valid for every row
    first = F.col("at") - F.col("window_at")
    matches = scratch.spool(
        inside.join(prefix, "shingle")
        .withColumn("first", first.cast("long"))
        .filter("first >= 0")
        .withColumn("run", F.split("words", " "))
        .filter(F.col("first") + F.col("size") <= F.size("run"))
        .filter(F.slice("run", F.greatest(F.col("first") + 1, F.lit(1)).cast("int"), F.col("size")) == F.split("window", " "))
        .select("words", "window", "first", (F.col("first") + F.col("size")).alias("last"))
        .distinct()
    )
    spans = matches.groupBy("words").agg(_merged(F.collect_set(F.struct("first", "last"))).alias("spans"))
    hit_items = (
        matches.select("words", "window")
        .distinct()
        .join(windows.select("item_id", F.col("words").alias("window")), "window")
        .groupBy("words")
        .agg(F.collect_set("item_id").alias("items"))
    )
    hits = spans.join(hit_items, "words")
    moved = F.transform(
        "spans", lambda s: F.struct((s["first"] + F.col("at")).alias("first"), (s["last"] + F.col("at")).alias("last"))
    )
    by_doc = (
        runs.join(hits, "words")
        .select("row_id", moved.alias("spans"), "items")
        .groupBy("row_id")
        .agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    )
    by_doc = _joined_spans(by_doc)
    kind = dict(items.dtypes)["item_id"]
    spans_type = "array<struct<first:long,last:long>>"
    return read.join(by_doc, "row_id", "left").select(
        "row_id",
        "doc_id",
        "n_words",
        F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"]), F.lit(0)).alias("n_hit"),
        F.coalesce("spans", F.array().cast(spans_type)).alias("spans"),
        F.coalesce("items", F.array().cast(f"array<{kind}>")).alias("item_ids"),
    )


def _own_shingles(windows: DataFrame, sizes: list[int], shingle: int) -> DataFrame:
    """(words, size, at, shingle): each window's shingles, whose size is given by its number of words."""
    parts = []
    for size in sizes or [shingle]:
        some = windows.filter(F.least("size", F.lit(shingle)) == size)
        parts.append(shingled(some, [size]).join(some, "words").select("words", "size", "at", "shingle"))
    return reduce(DataFrame.union, parts)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every whole document inside windows of ten words of benchmark items."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    found = contained_items(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))
    ids = F.array_sort(F.transform("item_ids", lambda i: i.cast("string")))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", ids).cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op10_sql() -> str:
    return r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least(10, len(ws)) AS size, array_to_string(ws[k:k + least(10, len(ws)) - 1], ' ') AS win
  FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS k FROM i WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT size FROM iw),
dw AS (
  SELECT doc_id, k, size, array_to_string(ws[k:k + size - 1], ' ') AS win
  FROM (SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS k FROM w CROSS JOIN sizes WHERE len(ws) >= size)),
m AS (SELECT doc_id, k, dw.size, item_id FROM dw JOIN iw USING (win)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + size)) AS p FROM m) GROUP BY doc_id),
n AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN h USING (doc_id) LEFT JOIN n USING (doc_id)
"""
