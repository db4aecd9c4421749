"""Operators over pages, held as an array per document or as a page table."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliomark.functions import pages as _pages
from foliomark.functions.headers import RUNNING_MIN
from foliomark.functions.images import image_name, link_item
from foliomark.operators.built import built
from foliomark.operators.ordered import SPAN, ordered_concat
from foliomark.operators.unnest import unnest


def pages_from_text(docs: DataFrame, text: str = "text", sep: str = "\f") -> DataFrame:
    """Add ``pages array<struct<page_no, text>>`` by cutting a text at form feeds."""
    cut = F.transform(
        F.split(F.col(text), sep),
        lambda page, i: F.struct((i + 1).alias("page_no"), page.alias("text")),
    )
    return docs.withColumn("pages", cut)


def enumerate_pages(docs: DataFrame, *keep: str) -> DataFrame:
    """Page table of a ``pages`` array column; page numbers start at 1."""
    kept = list(keep or ("doc_id",))
    return unnest(docs, kept, F.col("pages"), "p").select(*kept, "p.*")


def page_markers(pages: DataFrame) -> DataFrame:
    """Put the page marker items before the text of every page but the first."""
    items = F.concat(_pages.page_marker(F.col("page_no")), F.array(F.col("text")))
    return pages.withColumn("text", F.array_join(items, "\n"))


def page_separators(pages: DataFrame) -> DataFrame:
    return pages.withColumn("text", F.concat("text", F.lit("\n" + _pages.SEPARATOR)))


def page_tables(pages: DataFrame) -> DataFrame:
    """Append the rendered ``tables`` of every page to its text."""
    items = F.concat(F.array(F.col("text")), _pages.table_items(F.col("tables")))
    return pages.withColumn("text", F.array_join(items, "\n")).drop("tables")


def assemble_doc(pages: DataFrame, span: int = SPAN) -> DataFrame:
    """One text per document from a page table, pages joined by newlines in order."""
    return ordered_concat(pages, ["doc_id"], "page_no", span=span)


def assemble_arrays(docs: DataFrame, **options) -> DataFrame:
    """One text per document from a ``pages`` array column, without a shuffle."""
    return docs.withColumn("text", _pages.assemble(F.col("pages"), **options)).drop("pages")


def provenance_header(docs: DataFrame) -> DataFrame:
    header = _pages.provenance_header(F.col("stem"), F.col("name"))
    return docs.withColumn("text", F.concat(header, "text"))


# Repeated edge lines -----------------------------------------------------------------------


def strip_headers_footers(docs: DataFrame, at_least: int = RUNNING_MIN) -> DataFrame:
    """Drop repeated first / last lines of pages held as an array; no shuffle."""
    step = _pages.strip_repeated_edges if at_least == RUNNING_MIN else partial(
        _pages.strip_repeated_edges, at_least=at_least
    )
    texts = built(docs.sparkSession, step, "pages")
    cleaned = F.transform(
        F.arrays_zip(F.col("pages").alias("p"), texts.alias("t")),
        lambda z: z["p"].withField("text", z["t"]),
    )
    return docs.withColumn("pages", cleaned)


def strip_page_table(
    pages: DataFrame, at_least: int = RUNNING_MIN, span: int = SPAN
) -> DataFrame:
    """The same for a page table.

    The hot unit is an edge line repeated on all pages of a huge document. Counting goes in
    two levels, by run of ``span`` pages and then over the runs, and the verdict is joined
    back per run, so no task gets more than ``span`` pages of one key. Page texts cross the
    network once; the counts carry keys only.
    """
    # The lines stand in for the text from here on.
    cut = pages.withColumn("_edge", _pages.edges(F.coalesce("text", F.lit("")))).drop("text")
    keyed = cut.withColumn("_key", _pages.edge_keys(F.col("_edge"))).withColumn(
        "_run", F.floor(F.col("page_no") / span)
    )
    sides = F.array(
        F.struct(F.lit("top").alias("side"), F.col("_key.top").alias("key")),
        F.struct(F.lit("bottom").alias("side"), F.col("_key.bottom").alias("key")),
    )
    long = keyed.select("doc_id", "_run", F.inline_outer(sides)).where(F.col("key").isNotNull())
    per_run = long.groupBy("doc_id", "_run", "side", "key").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(W.partitionBy("doc_id", "side", "key"))
    often = per_run.withColumn("total", total).where(F.col("total") >= at_least)

    # A run has at most ``span`` distinct keys per side, so the sets stay small.
    def keys_of(side: str):
        return F.collect_set(F.when(F.col("side") == side, F.col("key"))).alias(f"_{side}")

    sets = often.groupBy("doc_id", "_run").agg(keys_of("top"), keys_of("bottom"))
    flagged = keyed.join(sets, ["doc_id", "_run"], "left")

    def hit(side: str):
        return F.coalesce(F.array_contains(f"_{side}", F.col(f"_key.{side}")), F.lit(False))

    text = _pages.drop_edges(F.col("_edge"), hit("top"), hit("bottom"))
    return flagged.select(*[c for c in pages.columns if c != "text"], text.alias("text"))


# Images ------------------------------------------------------------------------------------


def image_manifest(images: DataFrame, folder) -> DataFrame:
    """``name`` and ``path`` of every image of ``images(doc_id, page_no, img_no, content)``.

    ``img_no`` is the position in the page's image list, so nothing has to be renumbered: a
    failed image (no content) is left out and the others keep their numbers.
    """
    name = image_name(F.col("page_no"), F.col("img_no"))
    return (
        images.where(F.col("content").isNotNull())
        .withColumn("name", name)
        .withColumn("path", F.concat(folder, F.lit("/"), "name"))
    )


def attach_images(
    pages: DataFrame, images: DataFrame, folder, embed: bool = False, span: int = SPAN
) -> DataFrame:
    """Append the link lines of a page's images to its text."""
    content = F.col("content") if embed else None
    links = images.where(F.col("content").isNotNull()).select(
        "doc_id", "page_no", "img_no",
        link_item(F.col("page_no"), F.col("img_no"), folder, content).alias("links"),
    )
    per_page = ordered_concat(links, ["doc_id", "page_no"], "img_no", "links", span=span)
    joined = pages.join(per_page, ["doc_id", "page_no"], "left")
    text = F.concat_ws("\n", F.coalesce("text", F.lit("")), "links")
    return joined.withColumn("text", text).drop("links")
