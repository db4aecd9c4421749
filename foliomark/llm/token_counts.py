"""Token counts: huge texts are encoded in overlapping chunks and spliced where both chunks agree.

A text of at most ``chunk`` characters is encoded whole. A longer one is cut into chunks that overlap;
each chunk is encoded with offsets, far from the others. Two neighbours are spliced at a position that
both give as the begin of a pre-token (a unit the tokenizer cuts before it merges). Units are cut from
left to right by what follows, so from a common begin on both cuts are the same, and the counts left
and right of it add up exactly. Where the overlap holds no such position (one word as long as the
overlap), the text is cut anew with overlaps and chunks four times as large, at last as one chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliomark.llm.encoder import WordEncoder, load
from foliomark.llm.tables import map_batches, numbered, table
from foliomark.llm.words import slices
from foliomark.operators.spool import Scratch

CHUNK = 32_768
OVERLAP = 512
WIDER = 4
TOKEN_LIMIT = 2048
SLICE = 16 << 20


def count_tokens(docs: DataFrame, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> (doc_id, n_bytes, n_tokens, n_chunks, overlap), one row per row.

    ``path``: file of a tokenizer of the tokenizers library that drops white space (see ``encoder``).
    Null text: 0 bytes, 0 tokens. Repeated rows and null ids: each row is counted on its own. Other
    columns are left out, whatever their names. An empty table gives an empty table.
    """
    if not 0 < overlap <= chunk // 2:
        raise ValueError("overlap has to be above 0 and at most half of chunk")
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    short = whole_counts(rows.filter(F.char_length("text") <= chunk), path)
    scratch = Scratch(docs.sparkSession, "token-counts")
    huge = scratch.spool(numbered(rows.filter(F.char_length("text") > chunk)))
    parts, left = [short], huge
    while True:
        found = scratch.spool(spliced(left, path, chunk, overlap))
        parts.append(
            found.filter("n_tokens is not null").select("doc_id", "n_bytes", "n_tokens", "n_chunks", F.lit(overlap).alias("overlap"))
        )
        failed = found.filter("n_tokens is null").select("row_id")
        if failed.isEmpty():
            break
        left = huge.join(failed, "row_id", "left_semi").select(*huge.columns)
        chunk, overlap = chunk * WIDER, overlap * WIDER
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def whole_counts(rows: DataFrame, path: str) -> DataFrame:
    """Counts of texts that fit one chunk."""

    def step():  # noqa: ANN202
        encoder = WordEncoder(path)

        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for part in slices(batch, limit=SLICE):
                text = part.column("text")
                yield pa.record_batch(
                    {
                        "doc_id": part.column("doc_id"),
                        "n_bytes": pc.binary_length(text).cast(pa.int64()),
                        "n_tokens": pa.array(encoder.counts(text), pa.int64()),
                        "n_chunks": pa.array([1] * part.num_rows, pa.int64()),
                        "overlap": pa.array([0] * part.num_rows, pa.int32()),
                    }
                )

        return each

    kind = dict(rows.dtypes)["doc_id"]
    return map_batches(rows, step, f"doc_id {kind}, n_bytes long, n_tokens long, n_chunks long, overlap int")


def chunks(rows: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """(row_id, no, begin, last, text): chunks of ``chunk`` characters, each ``overlap`` into the next one."""

    def step():  # noqa: ANN202
        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for row in batch.select(["row_id", "text"]).to_pylist():
                text, step = row["text"], chunk - overlap
                begins = list(range(0, max(1, len(text) - overlap), step))
                for at in range(0, len(begins), 256):
                    some = begins[at : at + 256]
                    yield pa.record_batch(
                        {
                            "row_id": pa.array([row["row_id"]] * len(some), pa.int64()),
                            "no": pa.array(range(at, at + len(some)), pa.int64()),
                            "begin": pa.array(some, pa.int64()),
                            "last": pa.array([b == begins[-1] for b in some]),
                            "text": pa.array([text[b : b + chunk] for b in some]),
                        }
                    )

        return each

    return map_batches(rows, step, "row_id long, no long, begin long, last boolean, text string")


def encoded(parts: DataFrame, path: str, overlap: int) -> DataFrame:
    """Per chunk its number of tokens, and for both overlaps the begins of units and the tokens before each."""

    def step():  # noqa: ANN202
        tokenizer = load(path)

        def units(encoding, first: int, last: int, begin: int) -> list[dict]:  # noqa: ANN001
            """Begins of units in [first, last), in the whole text's characters."""
            out, words, offsets = [], encoding.word_ids, encoding.offsets
            for k in range(1, len(words)):
                at = offsets[k][0]
                if first < at < last and (words[k] != words[k - 1] or words[k] is None) and offsets[k - 1][1] <= at:
                    out.append({"at": begin + at, "before": k})
            return out[:-1]  # what follows the last one may be cut short by the chunk's end

        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for part in slices(batch, limit=SLICE // 8):
                rows = part.to_pylist()
                out = []
                for row, e in zip(rows, tokenizer.encode_batch([r["text"] for r in rows], add_special_tokens=False), strict=True):
                    size = len(row["text"])
                    out.append(
                        {
                            "row_id": row["row_id"],
                            "no": row["no"],
                            "n": len(e),
                            "head": units(e, 0, overlap, row["begin"]) if row["no"] else [],
                            "tail": [] if row["last"] else units(e, size - overlap, size, row["begin"]),
                            "last": row["last"],
                        }
                    )
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

        return each

    unit = pa.list_(pa.struct([("at", pa.int64()), ("before", pa.int64())]))
    arrow = pa.schema([("row_id", pa.int64()), ("no", pa.int64()), ("n", pa.int64()), ("head", unit), ("tail", unit), ("last", pa.bool_())])
    units_type = "array<struct<at:long,before:long>>"
    return map_batches(parts, step, f"row_id long, no long, n long, head {units_type}, tail {units_type}, last boolean")


def spliced(rows: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """(row_id, doc_id, n_bytes, n_tokens, n_chunks); n_tokens is null where two chunks have no common begin."""
    # the chunks of one text go to many tasks
    parts = encoded(chunks(rows, chunk, overlap).repartition("row_id", "no"), path, overlap)
    order = Window.partitionBy("row_id").orderBy("no")
    both = parts.withColumn("next", F.lead("head").over(order))
    shared = F.array_intersect(F.col("tail.at"), F.col("next.at"))
    at = F.when(F.size(shared) > 0, F.element_at(shared, (F.size(shared) / 2).cast("int") + 1))

    def before(units: str) -> F.Column:
        return F.element_at(F.filter(units, lambda u: u["at"] == F.col("splice")), 1)["before"]

    both = both.withColumn("splice", at).select(
        "row_id",
        "n",
        "last",
        F.when(F.col("splice").isNotNull(), before("tail")).alias("until"),
        F.when(F.col("splice").isNotNull(), before("next")).alias("skipped"),
    )
    # a chunk counts from its left splice to its right one: what its right neighbour skips is added there
    each = F.when(F.col("last"), F.col("n")).otherwise(F.col("until") - F.col("skipped"))
    lost = ~F.col("last") & F.col("until").isNull()
    counts = both.groupBy("row_id").agg(
        F.when(~F.bool_or(lost), F.sum(each)).alias("n_tokens"), F.count("*").alias("n_chunks")
    )
    sizes = rows.select("row_id", "doc_id", F.octet_length("text").cast("long").alias("n_bytes"))
    return sizes.join(counts, "row_id").select("row_id", "doc_id", "n_bytes", "n_tokens", "n_chunks")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text of documents by word_bpe_49k.json."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    counts = count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)
