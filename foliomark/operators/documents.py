"""Operators over ``docs(doc_id, text, ...)``: one row in, one row out, or exploded rows.

Everything here is a projection (plus an explode): no shuffle, so neither a frequent source
nor a long document can overload a task. The only aggregates are counts, which Spark combines
before shuffling.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomark.functions import cleanup as _cleanup
from foliomark.functions import headers as _headers
from foliomark.functions import tables as _tables
from foliomark.functions.lines import format_text, line_kind, line_markdown
from foliomark.functions.text import let, lines_of, shifted, strip
from foliomark.operators.built import built
from foliomark.operators.unnest import unnest


def map_text(docs: DataFrame, step: Callable[[Column], Column], text: str = "text") -> DataFrame:
    """Apply a text -> text expression to the text column."""
    return docs.withColumn(text, built(docs.sparkSession, step, text))


def cleanup(docs: DataFrame, text: str = "text") -> DataFrame:
    """All nine cleanup steps, in order, in one projection. Apply once."""
    return map_text(docs, _cleanup.cleanup, text)


def format_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """Classify and rewrite every line of every text."""
    return map_text(docs, format_text, text)


def explode_text(docs: DataFrame, parts: Column, ordinal: str, value: str, *keep: str) -> DataFrame:
    """One row per element with a 0-based ordinal."""
    return unnest(docs, list(keep or ("doc_id",)), parts, value, ordinal)


# Lines -------------------------------------------------------------------------------


def doc_lines(docs: DataFrame, *keep: str) -> DataFrame:
    return explode_text(docs, lines_of(F.col("text")), "line_no", "line", *keep)


def classify_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """Add ``kind`` and ``md`` to a line table; built-in expressions only."""
    stripped = lines.withColumn("_line", strip(F.col(line)))
    kinds = stripped.withColumn("kind", line_kind(F.col("_line")))
    return kinds.withColumn("md", line_markdown(F.col("_line"), F.col("kind"))).drop("_line")


# Headers -----------------------------------------------------------------------------


def parse_headers(docs: DataFrame) -> DataFrame:
    """``doc_id, header_no, level, key`` of every header line."""
    def levelled(lines: Column) -> Column:
        found = _headers.header_lines(lines)

        def entry(e: Column) -> Column:
            line = F.get(lines, e["i"])
            hashes = F.length(line) - F.length(F.ltrim(line, F.lit("#")))
            return F.struct(hashes.alias("level"), e["k"].alias("key"))

        return F.transform(found, entry)

    found = let(lines_of(F.col("text")), levelled)
    rows = explode_text(docs, found, "header_no", "h")
    return rows.select("doc_id", "header_no", "h.*")


def running_headers(docs: DataFrame) -> DataFrame:
    """``doc_id, key, n`` of the keys seen often enough in one document to be running headers.

    The count lies inside one row: equal keys are neighbours once sorted. No shuffle.
    """

    def runs(keys: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(keys) - 1)
        first = F.filter(at, lambda i: (i == 0) | (F.get(keys, i) != F.get(keys, i - 1)))

        def counted(starts: Column) -> Column:
            ends = F.concat(F.slice(starts, F.lit(2), F.size(starts) - 1), F.array(F.size(keys)))
            return F.zip_with(
                starts, ends, lambda a, b: F.struct(F.get(keys, a).alias("key"), (b - a).cast("long").alias("n"))
            )

        often = F.filter(let(first, counted), lambda r: r["n"] >= _headers.RUNNING_MIN)
        return F.when(F.size(keys) > 0, often)

    found = let(F.array_sort(_headers.header_keys(F.col("text"))), runs)
    return unnest(docs, ["doc_id"], found, "r").select("doc_id", "r.*")


def header_levels(docs: DataFrame) -> DataFrame:
    """``doc_id, level, new_level``: used levels and what gap compression makes of them."""

    def mapped(levels: Column) -> Column:
        low = F.get(levels, F.lit(0))
        closed = _headers.has_gap(levels)
        return F.transform(
            levels,
            lambda v, i: F.struct(
                v.alias("level"), F.when(closed, low + i).otherwise(v).alias("new_level")
            ),
        )

    found = let(_headers.header_levels(F.col("text")), mapped)
    return unnest(docs, ["doc_id"], found, "m").select("doc_id", "m.*")


# Picture-text blocks -------------------------------------------------------------------


def picture_blocks(docs: DataFrame) -> DataFrame:
    """``doc_id, block_no, block`` of the closed picture-text blocks."""
    return explode_text(docs, _tables.picture_blocks(F.col("text")), "block_no", "block")


def picture_rows(blocks: DataFrame) -> DataFrame:
    """``doc_id, block_no, row_no, row``."""
    rows = _tables.picture_rows(F.col("block"))
    return unnest(blocks, ["doc_id", "block_no"], rows, "row", "row_no").select(
        "doc_id", "block_no", "row_no", "row"
    )


def block_cells(blocks: DataFrame) -> DataFrame:
    """Add ``cells array<array<string>>`` to a block table."""
    rows = _tables.picture_rows(F.col("block"))
    return blocks.withColumn("cells", F.transform(rows, _tables.split_columns))


def block_shapes(blocks: DataFrame) -> DataFrame:
    """``doc_id, block_no, n_rows, width, matching, tabular`` of the non-empty blocks."""
    sized = block_cells(blocks).where(F.size("cells") > 0)
    n_rows = F.size("cells")
    modal = sized.withColumn("modal", _tables.modal_width(F.transform("cells", F.size)))
    return modal.select(
        "doc_id", "block_no", n_rows.alias("n_rows"), "modal.width", "modal.matching",
        _tables.is_tabular(F.col("modal"), n_rows).alias("tabular"),
    )


def fitted_rows(blocks: DataFrame) -> DataFrame:
    """``doc_id, block_no, row_no, cells`` of the tabular blocks, all rows of equal width."""

    def fit(cells: Column) -> Column:
        def with_modal(modal: Column) -> Column:
            fitted = F.transform(cells, lambda row: _tables.fit_row(row, modal["width"]))
            return F.when(_tables.is_tabular(modal, F.size(cells)), fitted)

        return let(_tables.modal_width(F.transform(cells, F.size)), with_modal)

    rows = let(F.col("cells"), fit)
    return unnest(block_cells(blocks), ["doc_id", "block_no"], rows, "cells", "row_no")


def render_blocks(blocks: DataFrame) -> DataFrame:
    return blocks.select("doc_id", "block_no", _tables.render_block(F.col("block")).alias("md"))


# Pipe tables -----------------------------------------------------------------------------


def table_islands(docs: DataFrame) -> DataFrame:
    """``doc_id, first_line, n_rows, has_separator`` of every run of table rows.

    The starts and the ends of the runs are two equally long arrays in the same order.
    """

    def find(lines: Column) -> Column:
        here = F.transform(lines, _tables.is_table_row)

        def bounds(is_row: Column) -> Column:
            no = F.lit(False)

            def places(edge: Column) -> Column:
                marked = F.transform(edge, lambda hit, i: F.when(hit, i))
                return F.filter(marked, lambda i: i.isNotNull())

            before = shifted(is_row, 1, no)
            after = shifted(is_row, -1, no)
            starts = places(F.zip_with(is_row, before, lambda h, b: h & ~b))
            ends = places(F.zip_with(is_row, after, lambda h, a: h & ~a))

            def island(start: Column, end: Column) -> Column:
                second = F.get(lines, start + 1)
                return F.struct(
                    start.alias("first_line"),
                    (end - start + 1).alias("n_rows"),
                    ((end > start) & _tables.is_separator_row(second)).alias("has_separator"),
                )

            return F.zip_with(starts, ends, island)

        return let(here, bounds)

    found = let(F.transform(lines_of(F.col("text")), strip), find)
    return unnest(docs, ["doc_id"], found, "t").select("doc_id", "t.*")
