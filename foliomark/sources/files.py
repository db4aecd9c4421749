"""Files as rows: scans, identity, validation and the extraction hook."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliomark.operators.calls import Calls
from foliomark.operators.spool import Scratch
from foliomark.sources.listing import contents, listing
from foliomark.sources.stores import qualified

# Fixed value: the two spellings a scan picks up; mixed case is not picked up.
PATTERN = "*.{pdf,PDF}"

FILES = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("modificationTime", T.TimestampType()),
    T.StructField("length", T.LongType()),
    T.StructField("content", T.BinaryType()),
])

PAGES = T.ArrayType(T.StructType([
    T.StructField("page_no", T.IntegerType()),
    T.StructField("text", T.StringType()),
    T.StructField("tables", T.ArrayType(T.ArrayType(T.ArrayType(T.StringType())))),
    T.StructField("images", T.ArrayType(T.StructType([
        T.StructField("img_no", T.IntegerType()),
        T.StructField("content", T.BinaryType()),
    ]))),
]))

# Input bytes after which a parser worker hands on what it has.
OUTPUT_BYTES = 8 << 20

# bytes -> pages in order, each a dict with "text" and optionally "tables" and "images".
Extractor = Callable[[bytes], Iterable[dict]]


def scan_flat(spark: SparkSession, folder: str, pattern: str = PATTERN, scratch: Scratch | None = None) -> DataFrame:
    """Files directly in a folder, one row each (``FILES``); a missing folder is an analysis error.

    Names that begin with ``_`` or ``.`` belong to it. Listed and read by tasks; the written listing
    belongs to ``scratch``.
    """
    return contents(listing(spark, folder, pattern, recursive=False, scratch=scratch))


def scan_tree(spark: SparkSession, folder: str, pattern: str = PATTERN, scratch: Scratch | None = None) -> DataFrame:
    """Files at any depth, with ``rel_path`` below the folder."""
    found = contents(listing(spark, folder, pattern, recursive=True, scratch=scratch))
    return found.withColumn("rel_path", relative_path(F.col("path"), qualified(spark, folder)))


def relative_path(path: Column, root: str) -> Column:
    """``path`` below the qualified folder ``root``; any other path is an error of its row's query."""
    start = root.rstrip("/") + "/"
    outside = F.raise_error(F.concat(F.lit(f"not below {start}: "), path)).cast("string")
    return F.when(F.startswith(path, F.lit(start)), F.substr(path, F.lit(len(start) + 1))).otherwise(outside)


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def file_stem(name: Column) -> Column:
    """Name without its last suffix; a leading or trailing dot starts no suffix."""
    return F.regexp_replace(name, r"(?s)(?<=.)\.[^.]+\z", "")


def parent(path: Column) -> Column:
    """Folder part with its final slash, empty when there is none."""
    return F.left(path, F.length(path) - F.length(file_name(path)))


def validate_inputs(files: DataFrame) -> DataFrame:
    """Add ``accepted`` and ``reason``; the suffix must be ``.pdf`` in any case."""
    is_pdf = F.lower(file_name(F.col("path"))).rlike(r"(?s)^.+\.pdf\z")
    return files.withColumn("accepted", is_pdf).withColumn(
        "reason", F.when(~is_pdf, F.concat(F.lit("not a PDF: "), "path"))
    )


def with_identity(
    files: DataFrame, output_dir: str | None = None, mirror: bool = False
) -> DataFrame:
    """Add ``name``, ``stem`` and ``out_path``.

    Default: next to the file. With ``output_dir``: flat in that folder, or, with ``mirror``,
    below the folders of ``rel_path``. The mirrored name loses ``.pdf`` and then ``.PDF``,
    any other suffix stays, as the tree wrapper does it.
    """
    name = file_name(F.col("path"))
    stem = file_stem(name)
    if output_dir is None:
        out = F.concat(parent(F.col("path")), stem)
    elif mirror:
        bare = F.regexp_replace(F.regexp_replace(name, r"(?s)(?<=.)\.pdf\z", ""), r"(?s)(?<=.)\.PDF\z", "")
        out = F.concat(F.lit(output_dir.rstrip("/") + "/"), parent(F.col("rel_path")), bare)
    else:
        out = F.concat(F.lit(output_dir.rstrip("/") + "/"), stem)
    return files.withColumns(
        {"name": name, "stem": stem, "out_path": F.concat(out, F.lit(".md"))}
    )


def corpus_listing(files: DataFrame) -> DataFrame:
    """``folder, n_files`` of a file table; an empty table gives an empty listing."""
    folder = parent(F.col("path")).alias("folder")
    return files.groupBy(folder).agg(F.count(F.lit(1)).alias("n_files")).orderBy("folder")


def extract(files: DataFrame, extractor: Extractor, seconds: float | None = None) -> DataFrame:
    """Run a caller's parser on every file: ``content`` becomes ``pages`` and ``error``.

    One row per file with its pages as an array: pages are born together, so keeping them
    together saves the shuffle that would collect them again. A parser failure becomes the
    row's ``error``, and so is content that is null or an answer of the wrong kind. Cells may be
    anything: ``str(cell or "")``. Who reads the result twice writes it first (``spool``). With
    ``seconds`` a parser that takes longer for a file is ended, and so is one that ends its process:
    that file fails, the others go on.
    """
    kept = [f for f in files.schema.fields if f.name != "content"]
    schema = T.StructType([
        *kept, T.StructField("pages", PAGES), T.StructField("error", T.StringType()),
    ])

    def cell(value: object) -> str:
        return str(value or "")

    def image(content: object) -> bytes | None:
        if content is None or isinstance(content, (bytes, bytearray, memoryview)):
            return None if content is None else bytes(content)
        raise TypeError(f"an image is {type(content).__name__}, not bytes")

    def page(no: int, raw: dict) -> dict:
        text = raw.get("text") or ""
        if not isinstance(text, str):
            raise TypeError(f"the text of page {no} is {type(text).__name__}, not str")
        images = [{"img_no": i, "content": image(c)} for i, c in enumerate(raw.get("images") or [], 1)]
        tables = [[[cell(c) for c in row] for row in table] for table in raw.get("tables") or []]
        return {"page_no": no, "text": text, "tables": tables, "images": images}

    def parse(content: bytes | None) -> list[dict]:
        if content is None:
            raise ValueError("no content")
        return [page(no, raw) for no, raw in enumerate(extractor(bytes(content)), 1)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with Calls(parse, seconds) as call:
            for batch in batches:
                # Output frames follow the input bytes, so a worker holds few large documents.
                sizes = batch["content"].map(lambda c: 0 if c is None else len(c)).cumsum()
                for _, part in batch.groupby(sizes // OUTPUT_BYTES, sort=True):
                    parsed = [call(content) for content in part["content"]]
                    yield part.drop(columns="content").assign(
                        pages=pd.Series([p for p, _ in parsed], index=part.index, dtype=object),
                        error=pd.Series([e for _, e in parsed], index=part.index, dtype=object),
                    )

    return files.mapInPandas(run, schema)


def quarantine(extracted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split into the documents that could be read and the failures."""
    ok = F.col("error").isNull()
    return extracted.where(ok), extracted.where(~ok)
