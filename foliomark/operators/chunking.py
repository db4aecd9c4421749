"""Chunking, external transforms per chunk, and putting the results back together."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomark.functions import chunks as _chunks
from foliomark.functions.text import strip
from foliomark.operators.calls import CALL_SECONDS, Calls
from foliomark.operators.ordered import ordered_concat
from foliomark.operators.spool import Scratch
from foliomark.operators.unnest import unnest

# Chunks joined by one first-level group: at the default limit about 5 MB of text.
CHUNK_SPAN = 64
# Bytes of chunks after which a worker hands on what it has.
OUTPUT_BYTES = 4 << 20


def paragraphs(docs: DataFrame) -> DataFrame:
    parts = _chunks.paragraphs(F.col("text"))
    return unnest(docs, ["doc_id"], parts, "paragraph", "para_no")


def chunk_documents(docs: DataFrame, limit: int = _chunks.CHUNK_LIMIT) -> DataFrame:
    """``doc_id, chunk_no, n_chunks, chunk``; cut inside the row, so no shuffle."""
    cut = docs.select("doc_id", _chunks.chunks(F.col("text"), limit).alias("chunks"))
    rows = unnest(
        cut, ["doc_id", F.size("chunks").alias("n_chunks")], F.col("chunks"), "chunk", "chunk_no"
    )
    return rows.select("doc_id", "chunk_no", "n_chunks", "chunk")


def chunk_requests(chunks: DataFrame, instruction: str) -> DataFrame:
    """One request per chunk: the instruction and the 1-based position ``i/n``."""
    position = F.concat_ws("/", (F.col("chunk_no") + 1).cast("string"), F.col("n_chunks").cast("string"))
    return chunks.withColumn("position", position).withColumn("instruction", F.lit(instruction))


def map_chunks(
    chunks: DataFrame, fn: Callable[[str], str], tasks: int | None = None, seconds: float | None = None
) -> DataFrame:
    """Apply an external transform to every chunk; a failure becomes a row, not a lost task.

    Adds ``result`` and ``error``. The chunks of a long document are born in one task; they are
    dealt out by chunk, to ``tasks`` tasks if given, so that slow calls for it run side by side.
    An answer that is no text is a failure. With ``seconds`` a call that takes longer is ended, its
    ``error`` is ``time-out``, and the other chunks go on; so do they after a call that ends its process.
    While calls of a task are held up, others run beside them, up to ``calls.BESIDE`` in a task.
    """
    dealt = chunks.repartition(*([tasks] if tasks else []), "doc_id", "chunk_no")

    def textual(chunk: str) -> str:
        result = fn(chunk)
        if not isinstance(result, str):
            raise TypeError(f"the transform gave {type(result).__name__}, not str")
        return result

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with Calls(textual, seconds) as call:
            for batch in batches:
                for part in _of_size(batch, "chunk"):
                    done = call.many(part.column("chunk").to_pylist())
                    added = [pa.array([d[k] for d in done], pa.string()) for k in (0, 1)]
                    yield pa.RecordBatch.from_arrays([*part.columns, *added], names=[*part.schema.names, "result", "error"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema.fields)
    return dealt.mapInArrow(run, f"{fields}, result string, error string")


def _of_size(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """Slices of about ``OUTPUT_BYTES`` of text, so that a worker holds few texts as objects."""
    sizes = pc.fill_null(pc.cast(pc.binary_length(batch.column(text)), pa.int64()), 0).to_numpy(zero_copy_only=False)
    slices = np.cumsum(sizes) // OUTPUT_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(slices)) + 1).tolist(), batch.num_rows]
    for begin, end in zip(cuts, cuts[1:], strict=False):
        if end > begin:
            yield batch.slice(begin, end - begin)


def reassemble(chunks: DataFrame, text: str = "chunk", span: int = CHUNK_SPAN) -> DataFrame:
    """Chunks of a document joined in order by a paragraph break."""
    joined = ordered_concat(chunks, ["doc_id"], "chunk_no", text, _chunks.BREAK, span)
    return joined.withColumnRenamed(text, "text")


def accepted_documents(results: DataFrame, span: int = CHUNK_SPAN) -> DataFrame:
    """``doc_id, _result`` of the documents all of whose chunks have a result that is not blank."""
    # An empty result and a failed one count alike; the counts ride along with the texts.
    kept = F.col("error").isNull() & (strip(F.coalesce("result", F.lit(""))) != "")
    counted = results.select("doc_id", "chunk_no", "n_chunks", "result", kept.cast("int").alias("good"))
    whole = ordered_concat(
        counted, ["doc_id"], "chunk_no", "result", _chunks.BREAK, span,
        {"good": F.sum, "n_chunks": F.max},
    )
    return whole.where(F.col("good") == F.col("n_chunks")).select("doc_id", strip(F.col("result")).alias("_result"))


def fallback_to_original(docs: DataFrame, results: DataFrame, span: int = CHUNK_SPAN) -> DataFrame:
    """Transformed text of every document, or its original text.

    ``results(doc_id, chunk_no, n_chunks, result, error)``. The unit is the document: one
    failed, blank or missing chunk keeps the original. ``transformed`` tells which it was.
    """
    accepted = accepted_documents(results, span)
    joined = docs.join(accepted, "doc_id", "left")
    return joined.select(
        *[c for c in docs.columns if c != "text"],
        F.coalesce("_result", "text").alias("text"),
        F.col("_result").isNotNull().alias("transformed"),
    )


def transform_documents(
    docs: DataFrame, fn: Callable[[str], str] | None, limit: int = _chunks.CHUNK_LIMIT,
    tasks: int | None = None, seconds: float | None = None, scratch: Scratch | None = None,
) -> DataFrame:
    """Chunk, transform and reassemble; without ``fn`` the documents pass through unchanged.

    The results of the external calls are written once, so that a lost executor does not repeat a
    call. They belong to ``scratch``: release it when the documents are stored.
    """
    if fn is None:
        return docs.withColumn("transformed", F.lit(False))
    scratch = scratch or Scratch(docs.sparkSession, "chunk-results")
    results = map_chunks(chunk_documents(docs, limit), fn, tasks, seconds).drop("chunk")
    return fallback_to_original(docs, scratch.spool(results))


@dataclass(frozen=True)
class Mode:
    """One way to transform a text: a hook, and how it is called.

    ``limit`` is the size of its chunks; with None it takes whole documents.
    """

    name: str
    call: Callable[[str], str]
    limit: int | None = _chunks.CHUNK_LIMIT
    seconds: float | None = CALL_SECONDS
    tasks: int | None = None


@dataclass(frozen=True)
class Cascade:
    """Documents after a cascade, what was tried for each, and the owner of the tables behind both."""

    docs: DataFrame
    attempts: DataFrame
    scratch: Scratch


def cascade(docs: DataFrame, modes: Sequence[Mode], scratch: Scratch | None = None) -> Cascade:
    """Transform documents by the first mode that succeeds; each mode sees only what those before it left.

    ``docs`` gets ``mode``, the name of the mode whose text was taken, null where the original stays
    (null and blank texts included: no mode makes something of them). ``attempts`` has a row per
    document and mode tried: ``n_calls, n_failed, n_blank`` and the least ``error``. Results of each
    mode are written before the next one starts, so no call is repeated, and with nothing left the
    rest of the modes are not called at all. Documents are known by ``doc_id``; rows without one
    keep their text.
    """
    names = [m.name for m in modes]
    if len(set(names)) < len(names):
        raise ValueError(f"modes need names of their own: {names}")
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "cascade")
    kind = dict(docs.dtypes)["doc_id"]
    taken: list[DataFrame] = []
    attempts: list[DataFrame] = []
    rest = docs.where(F.col("doc_id").isNotNull() & (strip(F.coalesce("text", F.lit(""))) != "")).select("doc_id", "text")
    for n, mode in enumerate(modes):
        if mode.limit is None:
            one = F.lit(1).alias("n_chunks")
            chunks = rest.select("doc_id", F.lit(0).alias("chunk_no"), one, F.col("text").alias("chunk"))
        else:
            chunks = chunk_documents(rest, mode.limit)
        results = scratch.spool(map_chunks(chunks, mode.call, mode.tasks, mode.seconds).drop("chunk"))
        failed, blank = F.col("error").isNotNull(), F.col("error").isNull() & (strip(F.coalesce("result", F.lit(""))) == "")
        tried = results.groupBy("doc_id").agg(
            F.count(F.lit(1)).alias("n_calls"), F.count(F.when(failed, 1)).alias("n_failed"),
            F.count(F.when(blank, 1)).alias("n_blank"), F.min("error").alias("error"),
        )
        attempts.append(tried.withColumn("mode", F.lit(mode.name)))
        accepted = scratch.spool(accepted_documents(results))
        taken.append(accepted.withColumn("mode", F.lit(mode.name)))
        if n + 1 < len(modes):
            rest = scratch.spool(rest.join(accepted.select("doc_id"), "doc_id", "left_anti"))
            if rest.isEmpty():
                break
    if not modes:
        nothing = "doc_id {0}, n_calls long, n_failed long, n_blank long, error string, mode string".format(kind)
        done = docs.withColumn("mode", F.lit(None).cast("string"))
        return Cascade(done, spark.createDataFrame([], nothing), scratch)
    others = [c for c in docs.columns if c not in ("text", "mode")]
    found = docs.join(reduce(DataFrame.unionByName, taken).withColumnRenamed("mode", "_mode"), "doc_id", "left")
    text = F.coalesce("_result", "text").alias("text")
    return Cascade(found.select(*others, text, F.col("_mode").alias("mode")), reduce(DataFrame.unionByName, attempts), scratch)
