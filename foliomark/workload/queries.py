"""Registered queries: every operator over the whole given tables.

``QUERIES[name](spark, sf_dir)``; the SQL counterparts are in ``oracle``.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomark.functions import chunks as _chunks
from foliomark.functions import cleanup as _cleanup
from foliomark.functions import headers as _headers
from foliomark.functions import hooks
from foliomark.functions import images as _images
from foliomark.functions import tables as _tables
from foliomark.functions.lines import is_bullet, is_caps_heading, is_numbered
from foliomark.functions.text import collapse_newlines, lines_of, strip
from foliomark.operators import chunking, documents, long_chunks, long_documents, pages, profile
from foliomark.operators.spool import Scratch, checkpoint_folder, remove
from foliomark.operators.unnest import unnest
from foliomark.plans.convert import ConvertOptions, convert, convert_files
from foliomark.sources import files, sinks
from foliomark.sources.document_files import export_documents, staging_kept, withdraw
from foliomark.sources.listing import listing
from foliomark.sources.stores import Stores, exists, is_folder, qualified
from foliomark.streaming.incremental import convert_changes, convert_new, current_corpus, new_files
from foliomark.workload import views

Query = Callable[[SparkSession, str], DataFrame]

CHUNK_LIMIT = 4_000

QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _on_noisy(name: str, step) -> None:
    """Register a text -> text step over the noisy documents."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        noisy = views.noisy_docs(spark, sf_dir)
        return documents.map_text(noisy, step).select("doc_id", "text")

    QUERIES[name] = run


for _name, _step in {
    "format_text": documents.format_text,
    "collapse_blank": collapse_newlines,
    "drop_replacement_char": _cleanup.drop_replacement_char,
    "drop_placeholders": _cleanup.drop_placeholders,
    "picture_tables": _tables.convert_picture_blocks,
    "keep_first_running": _headers.keep_first_running,
    "drop_consecutive": _headers.dedupe_headers,
    "rstrip_lines": _cleanup.rstrip_lines,
    "collapse_blank_lines": lambda t: collapse_newlines(_cleanup.rstrip_lines(t)),
    "compress_levels": _headers.compress_levels,
    "repair_separator": _tables.repair_tables,
    "final_newline": _cleanup.final_newline,
    "cleanup": _cleanup.cleanup,
}.items():
    _on_noisy(_name, _step)


# Lines -------------------------------------------------------------------------------------


def _noisy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.doc_lines(views.noisy_docs(spark, sf_dir))


@query
def trim_line(spark, sf_dir):
    return _noisy_lines(spark, sf_dir).withColumn("line", strip(F.col("line")))


@query
def classify_lines(spark, sf_dir):
    return documents.classify_lines(_noisy_lines(spark, sf_dir)).drop("line")


@query
def line_kinds(spark, sf_dir):
    """Lines per source and kind."""
    lines = documents.doc_lines(views.noisy_docs(spark, sf_dir), "source")
    kinds = documents.classify_lines(lines)
    return kinds.groupBy("source", "kind").agg(F.count(F.lit(1)).alias("n"))


@query
def caps_heading(spark, sf_dir):
    line = strip(F.col("line"))
    return _noisy_lines(spark, sf_dir).select(
        "doc_id", "line_no", is_caps_heading(line).alias("is_heading")
    )


@query
def bullet(spark, sf_dir):
    line = strip(F.col("line"))
    return _noisy_lines(spark, sf_dir).select("doc_id", "line_no", is_bullet(line).alias("is_bullet"))


@query
def numbered(spark, sf_dir):
    """Every second source's lines get a number in front, so both answers occur."""
    lines = documents.doc_lines(views.documents(spark, sf_dir), "doc_id", "source")
    number = F.concat((F.col("line_no") + 1).cast("string"), F.lit(". "), "line")
    line = F.when(F.col("source").endswith("1"), number).otherwise(F.col("line"))
    return lines.select("doc_id", "line_no", is_numbered(strip(line)).alias("is_numbered"))


# Headers -----------------------------------------------------------------------------------


@query
def parse_headers(spark, sf_dir):
    return documents.parse_headers(views.noisy_docs(spark, sf_dir))


@query
def header_key(spark, sf_dir):
    """How often each key occurs in the corpus."""
    headers = documents.parse_headers(views.noisy_docs(spark, sf_dir))
    return headers.groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@query
def running_headers(spark, sf_dir):
    return documents.running_headers(views.noisy_docs(spark, sf_dir))


@query
def removed_headers(spark, sf_dir):
    """Header lines removed as repeats, per source."""
    noisy = views.noisy_docs(spark, sf_dir)
    before = F.size(_headers.header_keys(F.col("text")))
    after = F.size(_headers.header_keys(F.col("clean")))
    cleaned = noisy.withColumn("clean", _headers.dedupe_headers(F.col("text")))
    return cleaned.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(before - after).alias("n_removed")
    )


@query
def header_levels(spark, sf_dir):
    return documents.header_levels(views.noisy_docs(spark, sf_dir))


# Tables --------------------------------------------------------------------------------------


def _cell_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table per document: a row per line, a cell per clause, empty cells null."""
    rows = F.transform(
        lines_of(F.col("text")),
        lambda line: F.transform(F.split(line, ", "), lambda c: F.when(c != "", c)),
    )
    return views.documents(spark, sf_dir).select("doc_id", rows.alias("rows"))


@query
def render_table(spark, sf_dir):
    return _cell_rows(spark, sf_dir).select("doc_id", _tables.render_table(F.col("rows")).alias("md"))


@query
def picture_blocks(spark, sf_dir):
    return documents.picture_blocks(views.noisy_docs(spark, sf_dir))


@query
def picture_rows(spark, sf_dir):
    return documents.picture_rows(picture_blocks(spark, sf_dir))


@query
def split_columns(spark, sf_dir):
    rows = picture_rows(spark, sf_dir)
    cells = _tables.split_columns(F.col("row"))
    return rows.select(
        "doc_id", "block_no", "row_no", F.size(cells).alias("n_cols"),
        F.array_join(cells, "¦").alias("cells"),
    )


@query
def modal_width(spark, sf_dir):
    return documents.block_shapes(picture_blocks(spark, sf_dir))


@query
def fit_row(spark, sf_dir):
    rows = documents.fitted_rows(picture_blocks(spark, sf_dir))
    return rows.withColumn("cells", F.array_join("cells", "¦"))


@query
def render_block(spark, sf_dir):
    return documents.render_blocks(picture_blocks(spark, sf_dir))


@query
def table_islands(spark, sf_dir):
    return documents.table_islands(views.noisy_docs(spark, sf_dir))


# Pages ---------------------------------------------------------------------------------------


def _page_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.enumerate_pages(views.noisy_paged(spark, sf_dir))


@query
def enumerate_pages(spark, sf_dir):
    return _page_table(spark, sf_dir)


@query
def pages_from_text(spark, sf_dir):
    cut = pages.pages_from_text(views.documents(spark, sf_dir), sep="\n")
    return pages.enumerate_pages(cut)


@query
def assemble_doc(spark, sf_dir):
    return pages.assemble_doc(_page_table(spark, sf_dir))


@query
def assemble_turns(spark, sf_dir):
    """Conversations as documents: a turn is a page."""
    turns = views.table(spark, sf_dir, "conversations")
    said = F.concat("role", F.lit(": "), "text")
    return pages.assemble_doc(
        turns.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"), said.alias("text"))
    )


@query
def assemble_arrays(spark, sf_dir):
    docs = views.noisy_paged(spark, sf_dir)
    return pages.assemble_arrays(docs, page_separators=True).select("doc_id", "text")


@query
def page_markers(spark, sf_dir):
    return pages.page_markers(_page_table(spark, sf_dir))


@query
def page_separators(spark, sf_dir):
    return pages.page_separators(_page_table(spark, sf_dir))


@query
def provenance_header(spark, sf_dir):
    stem = F.concat(F.col("source"), F.lit("-"), F.col("doc_id").cast("string"))
    docs = views.documents(spark, sf_dir).withColumn("stem", stem)
    named = docs.withColumn("name", F.concat("stem", F.lit(".pdf")))
    return pages.provenance_header(named).select("doc_id", "text")


def _table_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document's own lines as one page whose table is the document's clauses."""
    rows = _cell_rows(spark, sf_dir)
    empty = F.array().cast("array<array<string>>")
    return rows.select(
        "doc_id", F.lit(1).alias("page_no"), F.concat(F.lit("Page of "), F.col("doc_id").cast("string")).alias("text"),
        F.array("rows", empty).alias("tables"),
    )


@query
def page_tables(spark, sf_dir):
    return pages.page_tables(_table_pages(spark, sf_dir))


@query
def strip_headers_footers(spark, sf_dir):
    return pages.enumerate_pages(pages.strip_headers_footers(views.noisy_paged(spark, sf_dir)))


@query
def strip_page_table(spark, sf_dir):
    return pages.strip_page_table(_page_table(spark, sf_dir))


# Images --------------------------------------------------------------------------------------


def _page_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An image per line, numbered within its page; lines with a pipe stand for failures."""
    lines = documents.doc_lines(views.documents(spark, sf_dir))
    size = views.PAGE_LINES
    content = F.when(~F.contains("line", F.lit("|")), F.encode("line", "UTF-8"))
    return lines.select(
        "doc_id",
        (F.floor(F.col("line_no") / size) + 1).cast("int").alias("page_no"),
        (F.col("line_no") % size + 1).cast("int").alias("img_no"),
        content.alias("content"),
    )


def _folder():
    return _images.image_folder("images", F.concat(F.lit("d"), F.col("doc_id").cast("string")))


@query
def image_manifest(spark, sf_dir):
    return pages.image_manifest(_page_images(spark, sf_dir), _folder()).drop("content")


@query
def attach_images(spark, sf_dir):
    return pages.attach_images(_page_table(spark, sf_dir), _page_images(spark, sf_dir), _folder())


@query
def embed_images(spark, sf_dir):
    images = _page_images(spark, sf_dir).where(F.col("content").isNotNull())
    return images.withColumn("uri", _images.data_uri(F.col("content"))).drop("content")


# Chunks --------------------------------------------------------------------------------------


def _paragraph_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.replace("text", F.lit("\n"), F.lit("\n\n"))
    return views.documents(spark, sf_dir, "doc_id", "text").withColumn("text", text)


@query
def paragraphs(spark, sf_dir):
    return chunking.paragraphs(_paragraph_docs(spark, sf_dir))


@query
def chunk_pack(spark, sf_dir):
    """Packing of every text, also of those that would fit."""
    packed = _chunks.chunk_pack(F.col("text"), CHUNK_LIMIT // 4)
    return unnest(_paragraph_docs(spark, sf_dir), ["doc_id"], packed, "chunk", "chunk_no")


@query
def chunk_documents(spark, sf_dir):
    return chunking.chunk_documents(_paragraph_docs(spark, sf_dir), CHUNK_LIMIT)


@query
def chunk_requests(spark, sf_dir):
    return chunking.chunk_requests(chunk_documents(spark, sf_dir), "Tidy this text.").drop("n_chunks")


def _underscore() -> Callable[[str], str]:
    # A local function travels with the task, so workers need not import this module.
    return lambda chunk: chunk.replace(" ", "_")


@query
def map_chunks(spark, sf_dir):
    return chunking.map_chunks(chunk_documents(spark, sf_dir), _underscore()).drop("chunk")


@query
def reassemble(spark, sf_dir):
    return chunking.reassemble(chunk_documents(spark, sf_dir))


def _chunk_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of an external step that fails or stays blank for some documents."""
    bad = F.col("doc_id") % 10 == 2
    result = F.when(F.col("doc_id") % 10 == 1, F.lit(" \n")).when(~bad, F.concat(F.lit(" <"), "chunk", F.lit("> ")))
    error = F.when(bad, F.lit("time-out"))
    chunks = chunk_documents(spark, sf_dir)
    return chunks.select("doc_id", "chunk_no", "n_chunks", result.alias("result"), error.alias("error"))


@query
def fallback_to_original(spark, sf_dir):
    return chunking.fallback_to_original(_paragraph_docs(spark, sf_dir), _chunk_results(spark, sf_dir))


@query
def transform_documents(spark, sf_dir):
    """Chunk, call the hook per chunk, reassemble with fallback."""
    return chunking.transform_documents(_paragraph_docs(spark, sf_dir), _underscore(), CHUNK_LIMIT)


def _hangs_at_times() -> Callable[[str], str]:
    """A hook that gives no answer for a few chunks."""

    def call(chunk: str) -> str:
        if len(chunk) % 499 == 7:
            time.sleep(3600)
        return chunk.replace(" ", "_")

    return call


@query
def timed_chunks(spark, sf_dir):
    """Calls with a deadline: the hanging ones are rows, the others of their batch finish."""
    return chunking.map_chunks(chunk_documents(spark, sf_dir), _hangs_at_times(), 8, seconds=2.0).drop("chunk")


def _modes() -> list[chunking.Mode]:
    """Chunks first, some of which fail; then whole documents, some of which come back blank."""

    def chunk_by_chunk(chunk: str) -> str:
        if len(chunk) % 3 == 0:
            raise ValueError("every third")
        return chunk.replace(" ", "_")

    def whole(text: str) -> str:
        return " \n" if len(text) % 2 else f"<{text}>"

    return [
        chunking.Mode("chunks", chunk_by_chunk, CHUNK_LIMIT, seconds=None),
        chunking.Mode("whole", whole, limit=None, seconds=None),
    ]


@query
def cascade_documents(spark, sf_dir):
    """Each document by the first mode that succeeds, else its original."""
    return chunking.cascade(_paragraph_docs(spark, sf_dir), _modes()).docs


@query
def cascade_attempts(spark, sf_dir):
    """The calls each mode made for each document: none after one that succeeded."""
    return chunking.cascade(_paragraph_docs(spark, sf_dir), _modes()).attempts


# Documents larger than a row ---------------------------------------------------------------------

# Small runs, so that every document of the given tables goes over several of them.
RUN = 16


def _on_line_table(name: str, step: Callable) -> None:
    """Register a step on line tables over the lines of the noisy documents."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        scratch = Scratch(spark, "lines")
        lines = scratch.spool(_noisy_lines(spark, sf_dir).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "line"))
        return step(scratch, lines, RUN)

    QUERIES[name] = run


for _name, _line_step in {
    "long_artifacts": long_documents.drop_artifacts,
    "long_picture_blocks": long_documents.picture_blocks,
    "long_headers": long_documents.repeated_headers,
    "long_blank_lines": long_documents.blank_lines,
    "long_levels": long_documents.header_levels,
    "long_tables": long_documents.table_separators,
    "cleanup_lines": lambda scratch, lines, span: long_documents.cleanup_lines(lines, span, scratch),
}.items():
    _on_line_table(_name, _line_step)


@query
def paragraph_rows(spark, sf_dir):
    """Paragraphs of line tables."""
    lines = documents.doc_lines(_paragraph_docs(spark, sf_dir))
    return long_chunks.paragraph_rows(lines, RUN)


@query
def pack_paragraphs(spark, sf_dir):
    """Chunks of paragraph rows."""
    paragraphs = chunking.paragraphs(_paragraph_docs(spark, sf_dir))
    return long_chunks.pack_paragraphs(paragraphs, CHUNK_LIMIT // 4, RUN)


# Files ---------------------------------------------------------------------------------------


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Input paths with both suffix spellings, others, and names that collide."""
    doc_id = F.col("doc_id")
    suffix = F.element_at(F.array(*map(F.lit, (".pdf", ".PDF", ".Pdf", ".txt"))), (doc_id % 4 + 1).cast("int"))
    rel = F.concat(F.col("source"), F.lit("/d"), (doc_id % 50).cast("string"), suffix)
    docs = views.table(spark, sf_dir, "documents").select("doc_id", rel.alias("rel_path"))
    return docs.withColumn("path", F.concat(F.lit("/in/"), "rel_path"))


@query
def validate_inputs(spark, sf_dir):
    return files.validate_inputs(_paths(spark, sf_dir)).drop("rel_path")


@query
def with_identity(spark, sf_dir):
    placed = files.with_identity(_paths(spark, sf_dir))
    flat = files.with_identity(placed.withColumnRenamed("out_path", "beside"), "/out")
    tree = files.with_identity(flat.withColumnRenamed("out_path", "flat"), "/out", mirror=True)
    return tree.withColumnRenamed("out_path", "tree")


@query
def url_identity(spark, sf_dir):
    """Identity of web pages by the path of their address."""
    named = views.table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("path"))
    return files.with_identity(named, "/out")


@query
def corpus_listing(spark, sf_dir):
    return files.corpus_listing(_paths(spark, sf_dir))


@query
def path_collisions(spark, sf_dir):
    return sinks.path_collisions(files.with_identity(_paths(spark, sf_dir), "/out"))


@query
def superseded_outputs(spark, sf_dir):
    placed = files.with_identity(_paths(spark, sf_dir), "/out")
    # The path alone is not unique here, the document number makes it so.
    unique = placed.withColumn("path", F.concat_ws("#", "path", F.lpad(F.col("doc_id").cast("string"), 9, "0")))
    return sinks.mark_superseded(unique).select("doc_id", "out_path", "superseded")


def _by_form_feed() -> files.Extractor:
    """A parser hook that cuts at form feeds and fails on documents of a single page."""

    def parse(content: bytes) -> list[dict]:
        found = content.decode("utf-8").split("\f")
        if len(found) < 2:
            raise ValueError("single page")
        return [{"text": text} for text in found]

    return parse


def _extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paged documents written to bytes with form feeds and read back by a parser hook."""
    text = F.array_join(F.transform("pages", lambda p: p["text"]), "\f")
    raw = views.noisy_paged(spark, sf_dir).select("doc_id", "source", F.encode(text, "UTF-8").alias("content"))
    return files.extract(raw, _by_form_feed())


@query
def extract_pages(spark, sf_dir):
    read, _ = files.quarantine(_extracted(spark, sf_dir))
    return pages.enumerate_pages(read).select("doc_id", "page_no", "text")


@query
def quarantine(spark, sf_dir):
    _, failed = files.quarantine(_extracted(spark, sf_dir))
    return failed.select("doc_id", "error")


@query
def manifest(spark, sf_dir):
    path = F.concat(F.lit("/out/"), F.col("source"), F.lit("-"), F.col("doc_id").cast("string"), F.lit(".md"))
    # written once, so that the sort does not run the parser again
    read = _extracted(spark, sf_dir).select(path.alias("out_path"), "error")
    return sinks.manifest(Scratch(spark, "manifest").spool(read))


@query
def manifest_counts(spark, sf_dir):
    return sinks.manifest_counts(manifest(spark, sf_dir))


@query
def written_counts(spark, sf_dir):
    """The same counts, observed while the corpus is written."""
    scratch = Scratch(spark, "corpus")
    counts = sinks.write_corpus(_extracted(spark, sf_dir), f"{scratch.root}/corpus")
    scratch.release()
    return spark.createDataFrame([(k, n) for k, n in counts.items() if n], "status string, n long")


@query
def sql_pages(spark, sf_dir):
    """Pages by a parser in SQL text: a table function with LATERAL."""
    hooks.register_parser(spark, "parse_by_form_feed", _by_form_feed())
    text = F.array_join(F.transform("pages", lambda p: p["text"]), "\f")
    raw = views.noisy_paged(spark, sf_dir).select("doc_id", F.encode(text, "UTF-8").alias("content"))
    return spark.sql(
        "SELECT d.doc_id, p.page_no, p.text, p.error FROM {raw} d, LATERAL parse_by_form_feed(d.content) p", raw=raw
    )


@query
def sql_transform(spark, sf_dir):
    """Chunks transformed in SQL text."""
    hooks.register_transform(spark, "underscored", _underscore())
    return spark.sql(
        "SELECT c.doc_id, c.chunk_no, c.n_chunks, t.result, t.error FROM {chunks} c, LATERAL underscored(c.chunk) t",
        chunks=chunk_documents(spark, sf_dir),
    )


@query
def structure_profile(spark, sf_dir):
    """What every noisy document consists of and what cleanup removes."""
    return profile.structure_profile(views.noisy_docs(spark, sf_dir))


@query
def profile_totals(spark, sf_dir):
    return profile.profile_totals(profile.structure_profile(views.noisy_docs(spark, sf_dir), "source"), "source")


# Files out and back ------------------------------------------------------------------------------


def _file_name() -> Column:
    """Some names are hidden to Spark's own listing; none of them may be lost."""
    mark = F.when(F.col("doc_id") % 7 == 0, "_").when(F.col("doc_id") % 11 == 0, ".").otherwise("")
    return F.concat(mark, F.lit("d"), F.col("doc_id").cast("string"), F.lit(".md"))


def _exported(spark: SparkSession, sf_dir: str, folder: Column | None = None) -> tuple[str, DataFrame]:
    base = f"{checkpoint_folder(spark)}/files-{uuid.uuid4().hex}"
    docs = views.table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    place = F.concat(F.lit(f"{base}/out/"), *([folder, F.lit("/")] if folder is not None else []), _file_name())
    rows = docs.select(F.col("doc_id").cast("string").alias("path"), place.alias("out_path"), "text")
    return base, sinks.export_markdown(rows, f"{base}/manifest")


@query
def scan_flat(spark, sf_dir):
    """All documents written as files of one folder and scanned back."""
    base, _ = _exported(spark, sf_dir)
    found = files.scan_flat(spark, f"{base}/out", "*.md")
    return found.select(files.file_name(F.col("path")).alias("name"), F.col("content").cast("string").alias("text"))


@query
def scan_tree(spark, sf_dir):
    """The same in folders by source, one of them hidden."""
    folder = F.when(F.col("source") == "src1", "_src1/in").otherwise(F.col("source"))
    base, _ = _exported(spark, sf_dir, folder)
    found = files.scan_tree(spark, f"{base}/out", "*.md")
    return found.select("rel_path", F.col("content").cast("string").alias("text"))


@query
def write_markdown(spark, sf_dir):
    """The manifest of that export."""
    base, listing = _exported(spark, sf_dir)
    name = files.file_name(F.col("out_path"))
    return listing.select(F.col("path").cast("long").alias("doc_id"), name.alias("name"), "status", "error")


def _by_lines() -> files.Extractor:
    """A parser hook: four lines are a page, every line of it an image, lines with a pipe failed ones."""

    def parse(content: bytes) -> list[dict]:
        found = content.decode("utf-8").split("\n")
        pages = [found[k : k + 4] for k in range(0, len(found), 4)]
        return [{"text": "\n".join(p), "images": [None if "|" in x else x.encode() for x in p]} for p in pages]

    return parse


# Files of one portion may take so much disk; above this many portions the next would only cost time.
PORTION_BYTES, PORTIONS = 1 << 28, 32
# A file takes whole blocks, however small it is.
BLOCK = 1 << 12


def _with_images(spark: SparkSession, sf_dir: str, taken: Callable[[str, DataFrame, Scratch], DataFrame]) -> DataFrame:
    """What ``taken`` reads of the conversion and export of all documents with their images.

    Small files take many times their bytes on disk. So documents go in portions, each converted and
    exported from one run of the parser; what is read back goes into a table and the portion's files are handed to the
    next, which writes its own into them (``staging_kept``). Documents that claim one path are in one portion.
    """
    scratch = Scratch(spark, "portions")
    base = f"{checkpoint_folder(spark)}/images-{uuid.uuid4().hex}"
    name = F.concat(F.lit("/in/"), F.col("source"), F.lit("-"), F.col("doc_id").cast("string"), F.lit(".pdf"))
    docs = views.documents(spark, sf_dir)
    lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    room = docs.agg(F.sum((lines + 1) * BLOCK + 2 * F.octet_length("text")).alias("room")).first()["room"] or 0
    n = min(PORTIONS, 1 + room // PORTION_BYTES)
    placed = files.with_identity(docs.select(name.alias("path"), F.encode("text", "UTF-8").alias("content")), f"{base}/out")
    dealt = placed.withColumn("portion", F.pmod(F.xxhash64("out_path"), F.lit(n)).cast("int"))
    dealt.write.partitionBy("portion").parquet(f"{scratch.root}/dealt")
    with staging_kept(spark, f"{base}/manifest"):
        for k in range(n):
            raw = spark.read.schema(dealt.schema).parquet(f"{scratch.root}/dealt").where(F.col("portion") == k).drop("portion")
            done = convert_files(raw, _by_lines(), ConvertOptions(tables=False, extract_images=True))
            rows = export_documents(done, f"{base}/manifest")
            taken(base, rows, scratch).write.mode("append").parquet(f"{base}-read")
            withdraw(spark, rows, f"{base}/manifest")
    remove(spark, base)
    scratch.release()
    return spark.read.parquet(f"{base}-read")


@query
def exported_images(spark, sf_dir):
    """The image files of that export, read back."""

    def taken(base: str, rows: DataFrame, scratch: Scratch) -> DataFrame:
        if not exists(spark, f"{base}/out"):  # a portion without files
            return spark.createDataFrame([], "rel_path string, content string")
        found = files.scan_tree(spark, f"{base}/out", "*.png", scratch)
        return found.select("rel_path", F.col("content").cast("string").alias("content"))

    return _with_images(spark, sf_dir, taken)


@query
def exported_manifest(spark, sf_dir):
    """A row for every text and image of that export."""

    def taken(base: str, rows: DataFrame, scratch: Scratch) -> DataFrame:
        return rows.select("kind", "path", files.file_name(F.col("out_path")).alias("name"), "status", "error")

    return _with_images(spark, sf_dir, taken)


# A folder that changes -----------------------------------------------------------------------------


def _written(docs: DataFrame, base: str, name: str) -> None:
    """Every document as a file, those of one source in a hidden folder."""
    folder = F.when(F.col("source") == "src1", "_src1/in").otherwise(F.col("source"))
    place = F.concat(F.lit(f"{base}/in/"), folder, F.lit("/"), _file_name())
    rows = docs.select(F.col("doc_id").cast("string").alias("path"), place.alias("out_path"), "text")
    sinks.export_markdown(rows, f"{base}/{name}")


def _deleted(paths: DataFrame) -> int:
    def run(batches):  # noqa: ANN001, ANN202
        stores = Stores()
        for batch in batches:
            for path in batch["path"]:
                stores.delete(path)
            yield batch

    return paths.mapInPandas(run, "path string").count()


def _two_runs(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """A folder converted twice: in between, files are rewritten, deleted and added."""
    base = f"{checkpoint_folder(spark)}/changes-{uuid.uuid4().hex}"
    docs = views.table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    doc_id = F.col("doc_id")

    def step(raw: DataFrame) -> DataFrame:
        text = F.col("content").cast("string")
        error = F.when(F.char_length(text) % 10 == 0, "a multiple of ten")
        return raw.select("path", "rel_path", text.alias("text"), error.alias("error"))

    def converted() -> DataFrame:
        return convert_changes(spark, f"{base}/in", step, f"{base}/out", f"{base}/ledger", "*.md", recursive=True)

    _written(docs.where(doc_id % 3 != 0), base, "first")
    converted()
    again = docs.where((doc_id % 3 != 0) & (doc_id % 5 == 0)).withColumn("text", F.concat("text", F.lit(" again")))
    _written(again.unionByName(docs.where(doc_id % 3 == 0)), base, "second")
    gone = docs.where((doc_id % 3 != 0) & (doc_id % 7 == 3)).select(_file_name().alias("name"))
    listed = listing(spark, f"{base}/in", "*.md", recursive=True)
    _deleted(listed.withColumn("name", files.file_name(F.col("path"))).join(gone, "name").select("path"))
    return base, converted()


@query
def file_fates(spark, sf_dir):
    """What became of every file of that folder in the second run."""
    _, fates = _two_runs(spark, sf_dir)
    return fates.select(files.file_name(F.col("path")).alias("name"), "fate", "outcome", "error")


@query
def changed_corpus(spark, sf_dir):
    """The corpus after both runs: of each file that is still there, what its last contents gave."""
    base, _ = _two_runs(spark, sf_dir)
    corpus = current_corpus(spark, f"{base}/out", f"{base}/ledger")
    return corpus.select("rel_path", "text", "error")


@query
def folder_listing(spark, sf_dir):
    """Files per folder and their bytes, listed by tasks that hand on what they do not reach."""
    base = f"{checkpoint_folder(spark)}/files-{uuid.uuid4().hex}"
    _written(views.table(spark, sf_dir, "documents").select("doc_id", "text", "source"), base, "manifest")
    found = listing(spark, f"{base}/in", "*.md", recursive=True, budget=100)
    rel = files.relative_path(F.col("path"), qualified(spark, f"{base}/in"))
    dated = F.count(F.col("modificationTime"))
    return found.groupBy(files.parent(rel).alias("folder")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("length").alias("bytes"), dated.alias("dated")
    )


# Whole conversions -----------------------------------------------------------------------------


def _identified_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    stem = F.concat(F.col("source"), F.lit("-"), F.col("doc_id").cast("string"))
    docs = views.noisy_paged(spark, sf_dir).withColumn("stem", stem)
    named = docs.withColumn("name", F.concat("stem", F.lit(".pdf")))
    return named.withColumn("path", F.concat(F.lit("/in/"), "name"))


@query
def convert_pages(spark, sf_dir):
    """Pages to clean Markdown with provenance, page markers and formatted lines."""
    done = convert(_identified_pages(spark, sf_dir), ConvertOptions(tables=False))
    return done.select("doc_id", "text")


@query
def convert_stripped(spark, sf_dir):
    """The same without page headers and footers, page breaks and line formatting."""
    options = ConvertOptions(
        tables=False, strip_headers_footers=True, page_breaks=False, preserve_formatting=False
    )
    return convert(_identified_pages(spark, sf_dir), options).select("doc_id", "text")


@query
def incremental_cleanup(spark, sf_dir):
    """Cleanup as a stream over the files of the folder, run until nothing is new."""
    schema = views.table(spark, sf_dir, "documents").schema
    place = f"{sf_dir}/documents.parquet"
    # a large table is a folder of parts, a small one a single file
    whole = is_folder(spark, place)
    stream = new_files(spark, place if whole else sf_dir, schema, "parquet", None if whole else "documents.parquet")

    def step(docs: DataFrame) -> DataFrame:
        noisy = docs.select("doc_id", views.noisy_text(F.col("text")).alias("text"), "source")
        return documents.cleanup(noisy).select("doc_id", "text")

    base = f"{checkpoint_folder(spark)}/incremental-{uuid.uuid4().hex}"
    convert_new(stream, step, f"{base}/out", f"{base}/state").awaitTermination()
    remove(spark, f"{base}/state")
    return spark.read.parquet(f"{base}/out")
