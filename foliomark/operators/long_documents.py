"""Cleanup of documents that no row can hold, as tables of lines.

``doc_id, line_no, line`` instead of a text: the lines of a document, cut at its newlines, numbered from
0 without gaps. The result is that of ``cleanup`` on the whole text, line for line. Every step looks at
most at running values of the lines around (``scans.running``): the header that survived last, whether
a picture block is open, the line before and after. What belongs to a whole document or block (how often a
header occurs, the width of a table, the levels in use) is summed per run first and goes back per run, so
neither a document nor a block nor a repeated header ever is one task's work.

Only a single line, and a row of a picture block, must fit in a row. ``doc_id`` is not null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomark.functions import tables as _tables
from foliomark.functions.cleanup import PLACEHOLDER, REPLACEMENT
from foliomark.functions.headers import LEVEL, RUNNING_MIN, header_key, is_header
from foliomark.functions.text import is_blank, lines_of, strip
from foliomark.operators.ordered import concat_parts, ordered_concat
from foliomark.operators.scans import SPAN, Running, run_of, running
from foliomark.operators.spool import Scratch
from foliomark.operators.unnest import unnest

OPEN = _tables.BLOCK_START.removesuffix("\n")
#: behind all rows of a block that begin in the same line
LAST = 1 << 40
_PLACEHOLDER = PLACEHOLDER.removesuffix(r"\n?")


def lines_of_parts(parts: DataFrame, span: int = SPAN) -> DataFrame:
    """Lines of ``doc_id, part_no, text``: texts that joined by newlines in order are the document."""
    sized = parts.select("doc_id", F.col("part_no").cast("long").alias("part_no"), F.coalesce("text", F.lit("")).alias("text"))
    sized = sized.withColumn("n", F.size(lines_of(F.col("text"))).cast("long"))
    placed = running(sized, "doc_id", ["part_no"], [Running("first", F.col("n"), "sum")], span)
    rows = unnest(placed, ["doc_id", "first"], lines_of(F.col("text")), "line", "i")
    return rows.select("doc_id", (F.col("first") + F.col("i")).alias("line_no"), "line")


def parts_of_lines(lines: DataFrame, span: int = 1024) -> DataFrame:
    """``doc_id, part_no, text`` of cleaned lines; the parts joined by newlines, and one newline more, are the text."""
    parts = concat_parts(lines, ["doc_id"], "line_no", "line", "\n", span)
    return parts.withColumnRenamed("line", "text")


def _relined(scratch: Scratch, pieces: DataFrame, span: int, stored: bool = False) -> DataFrame:
    """Lines of ``doc_id, o1, o2, o3, piece, ends``: pieces in order, a line ends where a piece does."""
    order = ["o1", "o2", "o3"]
    twice = pieces if stored else scratch.spool(pieces)
    ends = F.col("ends").cast("long")
    one = F.lit(1).cast("long")
    values = [Running("line_no", ends, "sum"), Running("at", one, "sum"), Running("whole", F.col("ends"))]
    placed = scratch.spool(running(twice, "doc_id", order, values, span))
    scratch.drop(twice)
    alone = F.col("ends") & F.coalesce("whole", F.lit(True))
    single = placed.where(alone).select("doc_id", "line_no", F.col("piece").alias("line"))
    glued = ordered_concat(placed.where(~alone), ["doc_id", "line_no"], "at", "piece", "").select("doc_id", "line_no", F.col("piece").alias("line"))
    return single.unionByName(glued)


def _pieces(lines: DataFrame, piece: Column, ends: Column) -> DataFrame:
    """Pieces that come one from each line."""
    zero = F.lit(0).cast("long")
    return lines.select("doc_id", F.col("line_no").alias("o1"), zero.alias("o2"), zero.alias("o3"), piece.alias("piece"), ends.alias("ends"))


def _kept(scratch: Scratch, lines: DataFrame, span: int) -> DataFrame:
    """The lines with ``keep``, numbered anew."""
    stored = scratch.spool(lines)
    placed = running(stored, "doc_id", ["line_no"], [Running("_no", F.col("keep").cast("long"), "sum")], span)
    return placed.where("keep").select("doc_id", F.col("_no").alias("line_no"), "line")


def _per_run(rows: DataFrame, by: list[str], whole: DataFrame, span: int, at: str = "line_no") -> DataFrame:
    """``rows`` with the columns of ``whole(by, ...)``, sent to each run of rows once."""
    run = F.floor(F.col(at) / F.lit(span)).cast("long")
    marked = rows.withColumn("_run", run)
    spread = marked.select(*by, "_run").distinct().join(whole, by)
    return marked.join(spread, [*by, "_run"], "left").drop("_run")


# The steps ----------------------------------------------------------------------------------


def drop_artifacts(scratch: Scratch, lines: DataFrame, span: int) -> DataFrame:
    """Without replacement characters and placeholders; a placeholder at a line's end takes the newline too."""
    line = F.replace(F.col("line"), F.lit(REPLACEMENT), F.lit(""))
    held = F.contains(line, F.lit("**==> picture ["))
    # the replacement character is gone, so it can mark where placeholders were
    marked = F.when(held, F.regexp_replace(line, _PLACEHOLDER, REPLACEMENT)).otherwise(line)
    bare = F.replace(marked, F.lit(REPLACEMENT), F.lit(""))
    return _relined(scratch, _pieces(lines, bare, ~marked.endswith(REPLACEMENT)), span)


def picture_blocks(scratch: Scratch, lines: DataFrame, span: int) -> DataFrame:
    """Every closed picture-text block as its rendering.

    A start marker ends its line, an end marker may lie anywhere. Any line with a marker sets the state
    whatever it was before, so the state of a line is that of the nearest such line before it.
    """
    line = F.col("line")
    opens, closes = line.endswith(OPEN), F.contains(line, F.lit(_tables.BLOCK_END))
    states = [
        Running("state", F.when(F.col("opens") | F.col("closes"), F.col("opens"))),
        Running("end_at", F.when(F.col("closes"), F.col("line_no")), after=True),
    ]
    at = F.instr(line, _tables.BLOCK_END)

    def breaks_in(text: Column) -> Column:
        return (F.size(F.split(text, "<br>")) - 1).cast("long")

    # what the states are made of is told before the rows go to their runs, so sums over runs move no text
    told = lines.select(
        "doc_id", "line_no", "line", run_of("line_no", span).alias("_at"), opens.alias("opens"), closes.alias("closes"),
        F.when(closes, breaks_in(F.left(line, at - 1))).otherwise(breaks_in(line)).alias("breaks"),
    )
    marked = running(told, "doc_id", ["line_no"], states, span, "_at")
    inside = F.coalesce("state", F.lit(False))
    later = F.col("end_at").isNotNull()
    marked = marked.select(
        "doc_id", "line_no", "_at", "breaks", "line", "closes",
        # an opening marker inside a block is content, unless the block ends in the same line before it
        (F.col("opens") & (~inside | F.col("closes")) & later).alias("opening"),
        (inside & F.col("closes")).alias("closing"), (inside & ~F.col("closes") & later).alias("within"),
    )
    held_breaks = F.when(F.col("closing") | F.col("within"), F.col("breaks"))
    values = [Running("block", F.when(F.col("opening"), F.col("line_no"))), Running("row_no", held_breaks, "sum")]
    placed = scratch.spool(running(marked, "doc_id", ["line_no"], values, span, "_at").drop("_at", "breaks", "closes"))
    content = F.when(F.col("closing"), F.left(line, at - 1)).when(F.col("within"), line)
    cells = F.split(content, "<br>")
    tail = F.when(F.col("closing"), F.substr(line, at + len(_tables.BLOCK_END))).otherwise(line)
    placed = placed.withColumn("shown", tail)

    shown = F.col("shown")
    outside = F.when(F.col("opening"), F.left(shown, F.length(shown) - len(OPEN))).otherwise(shown)
    plain = _pieces(placed.where(~F.col("within")), outside, ~F.col("opening")).withColumn("o2", F.lit(LAST).cast("long"))

    # rows of a block lie between breaks, not lines
    held = placed.where(F.col("closing") | F.col("within"))
    parts = unnest(held, ["doc_id", "block", "row_no", "line_no"], cells, "part", "k")
    parts = parts.select("doc_id", "block", (F.col("row_no") + F.col("k")).alias("row_no"), "line_no", "part", F.struct("line_no", F.col("k").cast("long").alias("k")).alias("begin"))
    rows = ordered_concat(parts, ["doc_id", "block", "row_no"], "line_no", "part", "\n", carry={"begin": F.min})
    rows = rows.select("doc_id", "block", F.col("begin.line_no").alias("line_no"), F.col("begin.k").alias("k"), strip(F.col("part")).alias("row"))
    rows = scratch.spool(rows.where("row <> ''").withColumn("width", F.size(_tables.split_columns(F.col("row")))))
    widths = rows.groupBy("doc_id", "block", "width").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("line_no", "k")).alias("first"))
    shapes = widths.groupBy("doc_id", "block").agg(
        F.sum("n").alias("n_rows"), F.max(F.struct(F.col("n").alias("matching"), (-F.col("width")).alias("width"))).alias("modal"), F.min("first").alias("first")
    )
    shapes = shapes.withColumn("modal", F.struct((-F.col("modal.width")).alias("width"), F.col("modal.matching").alias("matching")))
    shaped = _per_run(rows, ["doc_id", "block"], shapes, span)
    width = F.col("modal.width")
    fitted = _tables.render_row(_tables.fit_row(_tables.split_columns(F.col("row")), width))
    head = F.when(F.struct("line_no", "k") == F.col("first"), F.concat(F.lit("\n"), _tables.separator(width))).otherwise("")
    tabular = _tables.is_tabular(F.col("modal"), F.col("n_rows"))
    rendered = F.when(tabular, F.concat(fitted, head)).otherwise(F.col("row"))
    table = unnest(shaped, ["doc_id", F.col("line_no").alias("o1"), F.col("k").alias("o2")], lines_of(rendered), "piece", "o3")
    table = table.select("doc_id", "o1", "o2", F.col("o3").cast("long").alias("o3"), "piece", F.lit(True).alias("ends"))
    return _relined(scratch, plain.unionByName(scratch.spool(table)), span, stored=True)


def repeated_headers(scratch: Scratch, lines: DataFrame, span: int) -> DataFrame:
    """Of running headers the first, and no header twice with only blank lines between."""
    line = F.col("line")
    key = F.when(line.startswith("#") & is_header(line), header_key(line))
    keyed = lines.select("doc_id", "line_no", "line", run_of("line_no", span).alias("_at"), key.alias("key"))
    seen = keyed.where("key IS NOT NULL").groupBy("doc_id", "_at", "key").agg(F.count(F.lit(1)).alias("n"), F.min("line_no").alias("first"))
    often = seen.groupBy("doc_id", "key").agg(F.sum("n").alias("n"), F.min("first").alias("first")).where(F.col("n") >= RUNNING_MIN)
    often = scratch.spool(often.select("doc_id", "key", "first"))
    # only headers meet the verdict on their key, the other lines stay where they are
    headers = _per_run(keyed.where("key IS NOT NULL"), ["doc_id", "key"], often, span)
    marked = headers.unionByName(keyed.where("key IS NULL").withColumn("first", F.lit(None).cast("long")))
    gone = F.col("first").isNotNull() & (F.col("line_no") > F.col("first"))
    # a header that stays, or a line of text, decides for the next header
    event = F.when(gone, None).when(F.col("key").isNotNull(), F.struct(F.col("key").alias("k"))).when(
        ~is_blank(line), F.struct(F.lit(None).cast("string").alias("k"))
    )
    told = marked.withColumn("gone", gone).withColumn("event", event)
    nearest = running(told, "doc_id", ["line_no"], [Running("before", F.col("event"))], span, "_at")
    again = F.col("first").isNull() & (F.col("key") != "") & (F.col("before.k") == F.col("key"))
    kept = nearest.select("doc_id", "line_no", "line", "_at", (~(F.col("gone") | F.coalesce(again, F.lit(False)))).alias("keep"))
    placed = running(kept, "doc_id", ["line_no"], [Running("_no", F.col("keep").cast("long"), "sum")], span, "_at")
    return placed.where("keep").select("doc_id", F.col("_no").alias("line_no"), "line")


def blank_lines(scratch: Scratch, lines: DataFrame, span: int) -> DataFrame:
    """No blanks at line ends, and one empty line of several; two at the begin and the end."""
    bare = scratch.spool(lines.withColumn("line", F.rtrim(F.col("line"), F.lit(" \t"))))
    values = [Running("before", F.col("line") == ""), Running("next", F.lit(True), after=True)]
    near = running(bare, "doc_id", ["line_no"], values, span)
    edge = (F.col("line_no") == 1) | F.col("next").isNull()
    out = _kept(scratch, near.withColumn("keep", (F.col("line") != "") | ~F.coalesce("before", F.lit(False)) | edge).drop("before", "next"), span)
    scratch.drop(bare)
    return out


def header_levels(scratch: Scratch, lines: DataFrame, span: int) -> DataFrame:
    """Gaps between the header levels of a document closed; a bare hash line is glued to the next one."""
    line = F.col("line")
    hashes = F.length(line) - F.length(F.ltrim(line, F.lit("#")))
    placed = running(lines, "doc_id", ["line_no"], [Running("next", F.lit(True), after=True)], span)
    bare = (hashes == F.length(line)) & (hashes <= 6) & F.col("next").isNotNull()
    levelled = scratch.spool(placed.withColumn("level", F.when(line.startswith("#"), F.when(bare | line.rlike(f"^{LEVEL}"), hashes))))
    run = F.floor(F.col("line_no") / F.lit(span)).cast("long")
    seen = levelled.where("level IS NOT NULL").groupBy("doc_id", run.alias("_r")).agg(F.collect_set("level").alias("used"))
    used = seen.groupBy("doc_id").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("used")))).alias("used"))
    gap = F.array_max("used") - F.array_min("used") + 1 > F.size("used")
    marked = _per_run(levelled, ["doc_id"], used.where(gap), span)
    new = F.get("used", F.lit(0)) + F.size(F.filter("used", lambda v: v < F.col("level")))
    moved = F.concat(F.repeat(F.lit("#"), new), F.lit(" "), F.substr(line, F.col("level") + 2))
    moves = F.col("used").isNotNull() & F.col("level").isNotNull()
    glued = moves & (F.col("level") == F.length(line))
    out = _relined(scratch, _pieces(marked, F.when(moves, moved).otherwise(line), ~F.coalesce(glued, F.lit(False))), span)
    scratch.drop(levelled)
    return out


def table_separators(scratch: Scratch, lines: DataFrame, span: int) -> DataFrame:
    """The missing separator behind the first row of a pipe table of two or more rows."""
    line = F.col("line")
    stripped = F.when(F.contains(line, F.lit("|")), strip(line)).otherwise("")
    bare = scratch.spool(lines.withColumn("t", stripped))
    near = running(bare, "doc_id", ["line_no"], [Running("p", F.col("t")), Running("n", F.col("t"), after=True)], span)
    row = {c: _tables.is_table_row(F.coalesce(F.col(c), F.lit(""))) for c in "tpn"}
    broken = row["t"] & ~row["p"] & row["n"] & ~_tables.is_separator_row(F.col("n"))
    added = F.concat(line, F.lit("\n"), _tables.separator(_tables.pipe_count(line) - 1))
    rows = unnest(near, ["doc_id", "line_no"], lines_of(F.when(broken, added).otherwise(line)), "piece", "k")
    pieces = rows.select(
        "doc_id", F.col("line_no").alias("o1"), F.col("k").cast("long").alias("o2"), F.lit(0).cast("long").alias("o3"), "piece", F.lit(True).alias("ends")
    )
    out = _relined(scratch, pieces, span)
    scratch.drop(bare)
    return out


def last_lines(scratch: Scratch, lines: DataFrame, span: int) -> DataFrame:
    """Without the empty lines at the end; the first line stays in any case."""
    near = running(lines, "doc_id", ["line_no"], [Running("text", F.when(F.col("line") != "", True), after=True)], span)
    kept = (F.col("line_no") == 0) | (F.col("line") != "") | F.col("text").isNotNull()
    return near.where(kept).select("doc_id", "line_no", "line")


STEPS = (drop_artifacts, picture_blocks, repeated_headers, blank_lines, header_levels, table_separators, last_lines)


def cleanup_lines(lines: DataFrame, span: int = SPAN, scratch: Scratch | None = None) -> DataFrame:
    """All steps of ``cleanup`` over ``doc_id, line_no, line``: the lines of the cleaned documents.

    The lines joined by newlines, and one newline more, are what ``cleanup`` gives for the whole text.
    Each step writes its lines once; the result belongs to ``scratch``.
    """
    scratch = scratch or Scratch(lines.sparkSession, "long-documents")
    begin = lines.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.coalesce("line", F.lit("")).alias("line"))
    now = scratch.spool(begin)
    for step in STEPS:
        part = Scratch(lines.sparkSession, "step")
        after = scratch.spool(step(part, now, span))
        part.release()
        scratch.drop(now)
        now = after
    return now
