"""End-to-end conversion as one declarative plan."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomark.functions.chunks import CHUNK_LIMIT
from foliomark.functions.images import image_folder
from foliomark.operators.chunking import Mode, cascade
from foliomark.operators.documents import cleanup
from foliomark.operators.spool import Scratch
from foliomark.operators.pages import assemble_arrays, provenance_header, strip_headers_footers
from foliomark.sources.document_files import document_images
from foliomark.sources.files import (
    Extractor,
    extract,
    scan_flat,
    scan_tree,
    validate_inputs,
    with_identity,
)


@dataclass(frozen=True)
class ConvertOptions:
    """What a conversion does. Stages that are off are left out of the plan.

    ``transform`` is one external hook, called per chunk; ``modes`` are several, each for what those
    before it left. ``call_seconds`` is the deadline of a ``transform`` call, ``parse_seconds`` of the parser's for a file.
    """

    preserve_formatting: bool = True
    page_breaks: bool = True
    page_separators: bool = False
    strip_headers_footers: bool = False
    tables: bool = True
    extract_images: bool = False
    image_dir: str = "images"
    embed_images: bool = False
    cleanup: bool = False
    transform: Callable[[str], str] | None = None
    chunk_limit: int = CHUNK_LIMIT
    transform_tasks: int | None = None
    call_seconds: float | None = None
    modes: tuple[Mode, ...] = ()
    parse_seconds: float | None = None

    def all_modes(self) -> tuple[Mode, ...]:
        if self.transform is None:
            return self.modes
        return (Mode("transform", self.transform, self.chunk_limit, self.call_seconds, self.transform_tasks), *self.modes)


def convert(docs: DataFrame, options: ConvertOptions | None = None, scratch: Scratch | None = None) -> DataFrame:
    """Documents with ``pages`` -> the same rows with their Markdown in ``text``.

    Expects ``path, name, stem, pages`` (and passes other columns on). Without the external
    step this is a chain of projections, so the corpus is converted without a shuffle. With it, what
    is written on the way belongs to ``scratch``: release it when the result is stored.
    """
    o = options or ConvertOptions()
    staged = strip_headers_footers(docs) if o.strip_headers_footers else docs
    staged = assemble_arrays(
        staged,
        preserve_formatting=o.preserve_formatting,
        page_breaks=o.page_breaks,
        page_separators=o.page_separators,
        tables=o.tables,
        image_folder=image_folder(o.image_dir, F.col("stem")) if o.extract_images else None,
        embed_images=o.embed_images,
    )
    staged = cleanup(provenance_header(staged))
    if not o.cleanup:
        return staged
    modes = o.all_modes()
    if not modes:
        warnings.warn("cleanup asked for without a transform: texts stay as they are", stacklevel=2)
        return staged
    # The path identifies a document from here on; a caller's doc_id and mode pass through.
    scratch = scratch or Scratch(docs.sparkSession, "converted")
    whole = scratch.spool(staged).withColumn("_row", F.struct(*staged.columns))
    keyed = whole.select(F.col("path").alias("doc_id"), "text", "_row")
    done = cascade(keyed, modes, scratch).docs
    others = [c for c in staged.columns if c != "text"]
    return done.select(*(F.col("_row")[c].alias(c) for c in others), "text").select(*staged.columns)


def convert_files(
    files: DataFrame, extractor: Extractor, options: ConvertOptions | None = None, scratch: Scratch | None = None
) -> DataFrame:
    """Identified files -> ``path, out_path, text, error``; failures stay as rows.

    With ``extract_images`` also ``images``, the image files the texts link to (``document_images``).
    """
    o = options or ConvertOptions()
    accepted = validate_inputs(files).where("accepted").drop("accepted", "reason")
    read = extract(accepted, extractor, o.parse_seconds)
    linked = ["images"] if o.extract_images and not o.embed_images else []
    if linked:
        read = read.withColumn("images", document_images(F.col("pages"), F.col("out_path"), F.col("stem"), o.image_dir))
    done = convert(read, o, scratch)
    return done.select("path", "out_path", F.when(F.col("error").isNull(), F.col("text")).alias("text"), "error", *linked)


def convert_directory(
    spark: SparkSession,
    folder: str,
    extractor: Extractor,
    output_dir: str | None = None,
    recursive: bool = False,
    options: ConvertOptions | None = None,
) -> DataFrame:
    """Convert the files of a folder; ``recursive`` mirrors its subfolders."""
    files = scan_tree(spark, folder) if recursive else scan_flat(spark, folder)
    placed = with_identity(files, output_dir or folder, mirror=recursive)
    return convert_files(placed, extractor, options)
