"""Tables inside text: rendering, picture-text blocks, separator repair."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliomark.functions.text import WS, let, on_lines, shifted, strip

# Markers around the text of a picture, and the share of rows that must
# have the most frequent column count for a block to be a table.
BLOCK_START = "**----- Start of picture text -----**<br>\n"
BLOCK_END = "**----- End of picture text -----**<br>"
TABULAR_SHARE = 0.4

BLOCK = rf"(?s)\Q{BLOCK_START}\E(.*?)\Q{BLOCK_END}\E"


def render_row(cells: Column) -> Column:
    """``| a | b |``; null cells are empty, pipes are not escaped."""
    return F.concat(F.lit("| "), F.array_join(cells, " | ", ""), F.lit(" |"))


def separator(width: Column) -> Column:
    return F.concat(F.lit("|"), F.array_join(F.array_repeat(F.lit("---"), width), "|"), F.lit("|"))


def render_table(rows: Column) -> Column:
    """Markdown of ``array<array<string>>``, first row = header; ragged rows stay ragged."""
    header = F.get(rows, F.lit(0))
    width = F.size(header)
    rendered = F.concat(
        F.array(render_row(header), separator(width)),
        F.transform(F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))), render_row),
    )
    return F.when((F.size(rows) > 0) & (width > 0), F.array_join(rendered, "\n")).otherwise("")


# Picture-text blocks ---------------------------------------------------------------


def picture_blocks(text: Column) -> Column:
    """Contents of the closed picture-text blocks of a text, in order.

    Behind the last end marker nothing is closed, and searching there would start over at each
    start marker.
    """
    tail = F.substring_index(text, BLOCK_END, -1)
    head = F.left(text, F.length(text) - F.length(tail))
    return F.regexp_extract_all(head, F.lit(BLOCK), F.lit(1))


def picture_rows(block: Column) -> Column:
    """Non-blank stripped rows of a block."""
    parts = F.split(block, rf"<br>[{WS}]*\n?")
    return F.filter(F.transform(parts, strip), lambda row: row != "")


def split_columns(row: Column) -> Column:
    return F.split(row, rf"[{WS}]{{2,}}")


def modal_width(widths: Column) -> Column:
    """``struct(width, matching)``: most frequent value, the smallest on ties.

    One pass over the sorted widths with a fixed-size state.
    """
    zero = F.lit(0)
    start = F.struct(
        zero.alias("run"), zero.alias("run_n"), zero.alias("width"), zero.alias("matching")
    )

    def step(s: Column, w: Column) -> Column:
        run_n = F.when(s["run"] == w, s["run_n"] + 1).otherwise(F.lit(1))
        better = run_n > s["matching"]
        return F.struct(
            w.alias("run"),
            run_n.alias("run_n"),
            F.when(better, w).otherwise(s["width"]).alias("width"),
            F.when(better, run_n).otherwise(s["matching"]).alias("matching"),
        )

    return F.aggregate(
        F.sort_array(widths),
        start,
        step,
        lambda s: F.struct(s["width"].alias("width"), s["matching"].alias("matching")),
    )


def is_tabular(modal: Column, n_rows: Column) -> Column:
    return (modal["width"] > 1) & (modal["matching"] >= n_rows * F.lit(TABULAR_SHARE))


def fit_row(cells: Column, width: Column) -> Column:
    """Pad a short row with empty cells; merge surplus cells into the last one."""
    size = F.size(cells)
    padded = F.concat(cells, F.array_repeat(F.lit(""), width - size))
    merged = F.concat(
        F.slice(cells, F.lit(1), width - 1),
        F.array(F.array_join(F.slice(cells, width, size - width + 1), "  ")),
    )
    return F.when(size < width, padded).when(size > width, merged).otherwise(cells)


def render_block(block: Column) -> Column:
    """Markdown of one block: a table when it looks tabular, else its plain rows."""

    def with_rows(rows: Column) -> Column:
        plain = F.concat(F.array_join(rows, "\n"), F.lit("\n"))

        def with_cells(cells: Column) -> Column:
            def with_modal(modal: Column) -> Column:
                fitted = F.transform(cells, lambda row: fit_row(row, modal["width"]))
                table = F.concat(let(fitted, render_table), F.lit("\n"))
                return F.when(is_tabular(modal, F.size(cells)), table).otherwise(plain)

            return let(modal_width(F.transform(cells, F.size)), with_modal)

        return F.when(F.size(rows) == 0, "").otherwise(
            let(F.transform(rows, split_columns), with_cells)
        )

    return let(picture_rows(block), with_rows)


def convert_picture_blocks(text: Column) -> Column:
    """Replace every closed picture-text block by its rendering.

    Normally every start marker has its end marker before the next one, and one cut at the
    starts is enough. Texts with unclosed or nested starts take the general way.
    """

    def convert(t: Column) -> Column:
        def on_parts(parts: Column) -> Column:
            opened = F.slice(parts, F.lit(2), F.size(parts) - 1)

            def on_opened(opened: Column) -> Column:
                def woven(part: Column) -> Column:
                    halves = F.split(part, rf"\Q{BLOCK_END}\E", 2)
                    return let(halves, lambda h: F.concat(render_block(h.getItem(0)), h.getItem(1)))

                rest = F.concat(F.slice(parts, 1, 1), F.transform(opened, woven))
                closed = F.forall(opened, lambda part: F.contains(part, F.lit(BLOCK_END)))
                return F.when(closed, F.array_join(rest, "")).otherwise(_convert_any_blocks(t))

            return let(opened, on_opened)

        return let(F.split(t, rf"\Q{BLOCK_START}\E"), on_parts)

    return F.when(F.contains(text, F.lit(BLOCK_START)), let(text, convert)).otherwise(text)


def _convert_any_blocks(text: Column) -> Column:
    """The general way: from each start to the next end, whatever lies between.

    Only the part up to the last end marker is searched, so a text full of unclosed start
    markers stays linear.
    """
    tail = F.substring_index(text, BLOCK_END, -1)
    head = F.left(text, F.length(text) - F.length(tail))

    def weave(h: Column) -> Column:
        outside = F.split(h, BLOCK)
        rendered = F.transform(picture_blocks(h), render_block)
        # One more outside part than blocks: the last one meets a null.
        woven = F.zip_with(outside, rendered, lambda o, r: F.concat(o, F.coalesce(r, F.lit(""))))
        return F.array_join(woven, "")

    return F.concat(let(head, weave), tail)


# Pipe tables already in the text -----------------------------------------------------


def is_table_row(stripped: Column) -> Column:
    return stripped.startswith("|") & stripped.endswith("|")


def is_separator_row(stripped: Column) -> Column:
    """Two or more cells of blanks, dashes and colons; blanks alone count.

    Same language as ``cell(|cell)+`` between pipes, but without a repeated group, so a row
    of any width is matched without recursion.
    """
    return (
        stripped.rlike(rf"^\|[{WS}\-:|]+\|\z")
        & ~F.contains(stripped, F.lit("||"))
        & (pipe_count(stripped) >= 3)
    )


def pipe_count(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit("|"), F.lit("")))


def repair_in(lines: Column) -> Column:
    """The lines, with a missing separator appended to the first row of a table.

    The first row of a table is a row whose previous line is not one, so each line only
    looks at its neighbours.
    """

    def fix(z: Column) -> Column:
        broken = (
            is_table_row(z["t"])
            & ~is_table_row(z["p"])
            & is_table_row(z["n"])
            & ~is_separator_row(z["n"])
        )
        added = F.concat(z["l"], F.lit("\n"), separator(pipe_count(z["l"]) - 1))
        return F.when(broken, added).otherwise(z["l"])

    def zip_neighbours(stripped: Column) -> Column:
        # The cast names the fields, whatever the planner called them.
        return F.arrays_zip(
            lines, stripped, shifted(stripped, 1, F.lit("")), shifted(stripped, -1, F.lit(""))
        ).cast("array<struct<l:string,t:string,p:string,n:string>>")

    # Only a line with a pipe can be a row; the others need no stripping.
    candidates = F.transform(
        lines, lambda line: F.when(F.contains(line, F.lit("|")), strip(line)).otherwise("")
    )

    def repaired(stripped: Column) -> Column:
        some = F.exists(stripped, lambda line: line != "")
        return F.when(some, F.transform(zip_neighbours(stripped), fix)).otherwise(lines)

    return let(candidates, repaired)


def repair_tables(text: Column) -> Column:
    """Insert a missing separator after the first row of every table of two or more rows."""
    return F.when(F.contains(text, F.lit("|")), on_lines(text, repair_in)).otherwise(text)
