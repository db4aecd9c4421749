"""What a text consists of and what cleanup takes away from it: counts that add up over documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomark.functions import cleanup as _cleanup
from foliomark.functions import headers as _headers
from foliomark.functions import tables as _tables
from foliomark.functions.lines import line_kind
from foliomark.functions.text import collapse_newlines, let, lines_of, strip
from foliomark.operators.built import built

KINDS = ("blank", "heading", "bullet", "numbered", "paragraph")
#: the steps of ``cleanup`` by what they do, in order
STEPS: tuple[tuple[str, Callable[[Column], Column]], ...] = (
    ("artifacts", lambda t: _cleanup.drop_placeholders(_cleanup.drop_replacement_char(t))),
    ("pictures", _tables.convert_picture_blocks),
    ("headers", _headers.dedupe_headers),
    ("blanks", lambda t: collapse_newlines(_cleanup.rstrip_lines(t))),
    ("levels", _headers.compress_levels),
    ("tables", _tables.repair_tables),
    ("end", _cleanup.final_newline),
)


def _kind_counts(lines: Column) -> Column:
    """One fold over the lines: a counter for each kind."""
    zero = F.struct(*[F.lit(0).cast("long").alias(k) for k in KINDS])

    def step(counts: Column, line: Column) -> Column:
        def counted(kind: Column) -> Column:
            return F.struct(*[(counts[k] + (kind == k).cast("long")).alias(k) for k in KINDS])

        return let(line_kind(strip(line)), counted)

    return F.aggregate(lines, zero, step)


def text_profile(text: Column) -> Column:
    """A struct of counts: characters, lines by kind, headers, picture blocks, and characters each step removes.

    A step that adds characters removes a negative number of them.
    """
    sizes = [F.char_length(text).cast("long").alias("n_chars")]

    def after(value: Column, rest: tuple, removed: list[Column]) -> Column:
        if not rest:
            return F.struct(*removed)
        (name, step), *more = rest

        def measured(done: Column) -> Column:
            less = (F.char_length(value) - F.char_length(done)).cast("long").alias(f"removed_{name}")
            return after(done, tuple(more), [*removed, less])

        return let(step(value), measured)

    def with_lines(lines: Column) -> Column:
        headers = F.size(_headers.header_lines(lines)).cast("long").alias("n_headers")
        blocks = F.size(_tables.picture_blocks(text)).cast("long").alias("n_picture_blocks")
        own = [*sizes, F.size(lines).cast("long").alias("n_lines"), headers, blocks]
        return let(
            _kind_counts(lines),
            lambda k: let(after(text, STEPS, []), lambda r: F.struct(
                *own, *[k[x].alias(f"n_{x}") for x in KINDS], *[r[f"removed_{n}"].alias(f"removed_{n}") for n, _ in STEPS]
            )),
        )

    return let(lines_of(text), with_lines)


def structure_profile(docs: DataFrame, *keep: str) -> DataFrame:
    """``doc_id`` (or ``keep``) and the counts of every document's text, in one projection; null texts are empty."""
    filled = docs.withColumn("text", F.coalesce("text", F.lit("")))
    made = filled.select(*(keep or ("doc_id",)), built(docs.sparkSession, text_profile, "text").alias("p"))
    return made.select(*(keep or ("doc_id",)), "p.*")


def profile_totals(profiles: DataFrame, *by: str) -> DataFrame:
    """Sums of all counts by the given columns, and the number of documents."""
    counts = [c for c in profiles.columns if c.startswith(("n_", "removed_"))]
    return profiles.groupBy(*by).agg(F.count(F.lit(1)).alias("n_docs"), *[F.sum(c).alias(c) for c in counts])
