"""Pages of a document held as an array column, so that assembly needs no shuffle.

A page is ``struct<page_no int, text string, ...>`` with optional ``tables`` and ``images``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliomark.functions.headers import RUNNING_MIN, header_key, occurrences
from foliomark.functions.images import link_item
from foliomark.functions.lines import format_text
from foliomark.functions.tables import render_table
from foliomark.functions.text import is_blank, let, lines_of

SEPARATOR = "\n-----\n"


def provenance_header(stem: Column, name: Column) -> Column:
    return F.concat(
        F.lit("# "), stem, F.lit("\n\n*Converted from: "), name, F.lit("*\n\n---\n\n")
    )


def page_marker(page_no: Column) -> Column:
    """Items put before a page: none before the first one."""
    numbered = F.concat(F.lit("*Page "), page_no.cast("string"), F.lit("*\n\n"))
    return F.when(page_no > 1, F.array(F.lit("\n---\n"), numbered)).otherwise(
        F.array().cast("array<string>")
    )


def table_items(tables: Column) -> Column:
    """One item per table, to follow the page text."""
    items = F.transform(tables, lambda t: F.concat(F.lit("\n"), render_table(t), F.lit("\n")))
    return F.coalesce(items, F.array().cast("array<string>"))


def page_text(page: Column, preserve_formatting: bool) -> Column:
    text = F.coalesce(page["text"], F.lit(""))
    return format_text(text) if preserve_formatting else text


def page_items(
    page: Column,
    *,
    preserve_formatting: bool = True,
    page_breaks: bool = True,
    page_separators: bool = False,
    tables: bool = False,
    image_folder: Column | None = None,
    embed_images: bool = False,
) -> Column:
    """All items of one page in their order, ``array<string>``."""
    parts = []
    if page_breaks:
        parts.append(page_marker(page["page_no"]))
    parts.append(F.array(page_text(page, preserve_formatting)))
    if image_folder is not None:
        # A failed image has no content: it is skipped but keeps its number.
        there = F.filter(page["images"], lambda image: image["content"].isNotNull())
        links = F.transform(
            there,
            lambda image: link_item(
                page["page_no"], image["img_no"], image_folder,
                image["content"] if embed_images else None,
            ),
        )
        parts.append(F.coalesce(links, F.array().cast("array<string>")))
    if tables:
        parts.append(table_items(page["tables"]))
    if page_separators:
        parts.append(F.array(F.lit(SEPARATOR)))
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def assemble(pages: Column, **options) -> Column:
    """Text of a document: the items of all pages, in page order, joined by newlines."""
    ordered = F.sort_array(pages) if options.pop("unordered", False) else pages
    items = F.transform(ordered, lambda page: page_items(page, **options))
    return F.array_join(F.flatten(items), "\n")


# Repeated page headers and footers ---------------------------------------------------


def edge_key(line: Column) -> Column:
    """Key of a page's edge line; page numbers do not make lines differ."""
    return F.regexp_replace(header_key(line), r"(?U)\d+", "#")


def edges(text: Column) -> Column:
    """``struct(lines, top, bottom)``: lines and positions of the first / last non-blank one."""

    def find(lines: Column) -> Column:
        def positions(filled: Column) -> Column:
            top = F.array_position(filled, True)
            bottom = F.size(filled) + 1 - F.array_position(F.reverse(filled), True)
            return F.struct(
                lines.alias("lines"),
                F.when(top > 0, top.cast("int") - 1).alias("top"),
                F.when(top > 0, bottom.cast("int") - 1).alias("bottom"),
            )

        return let(F.transform(lines, lambda line: ~is_blank(line)), positions)

    return let(lines_of(text), find)


def edge_keys(edge: Column) -> Column:
    """``struct(top, bottom)`` keys of a page's edges; null for a blank page."""
    return F.struct(
        edge_key(F.get(edge["lines"], edge["top"])).alias("top"),
        edge_key(F.get(edge["lines"], edge["bottom"])).alias("bottom"),
    )


def drop_edges(edge: Column, top: Column, bottom: Column) -> Column:
    """Page text without its first and/or last non-blank line."""
    kept = F.filter(
        edge["lines"],
        lambda line, i: ~((top & (i == edge["top"])) | (bottom & (i == edge["bottom"]))),
    )
    untouched = F.array_join(edge["lines"], "\n")
    return F.when(top | bottom, F.array_join(kept, "\n")).otherwise(untouched)


def strip_repeated_edges(pages: Column, at_least: int = RUNNING_MIN) -> Column:
    """Page texts without the edge lines seen at the same edge on ``at_least`` pages.

    Returns ``array<string>`` aligned with ``pages``.
    """

    def on_edges(found: Column) -> Column:
        def flagged(keys: Column) -> Column:
            top = occurrences(F.transform(keys, lambda k: k["top"]), at_least)
            bottom = occurrences(F.transform(keys, lambda k: k["bottom"]), at_least)
            flags = F.zip_with(
                top, bottom, lambda t, b: F.struct(t["often"].alias("t"), b["often"].alias("b"))
            )
            return F.zip_with(found, flags, lambda e, f: drop_edges(e, f["t"], f["b"]))

        return let(F.transform(found, edge_keys), flagged)

    return let(F.transform(pages, lambda p: edges(F.coalesce(p["text"], F.lit("")))), on_edges)
