"""The nine cleanup steps as text -> text expressions, and their fixed order.

``cleanup`` is one projection: a document goes in and comes out in the same row, so the
corpus is cleaned without a shuffle, whatever the distribution of keys.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliomark.functions.headers import compress_in, dedupe_headers
from foliomark.functions.tables import convert_picture_blocks, repair_in
from foliomark.functions.text import (
    collapse_blank,
    drop_last_blank,
    let,
    lines_of,
    on_lines,
    rstrip_each,
)

# The replacement character and the line left behind by an omitted picture.
REPLACEMENT = "\ufffd"
PLACEHOLDER = r"(?U)\*\*==> picture \[\d+ x \d+\] intentionally omitted <==\*\*\n?"


def drop_replacement_char(text: Column) -> Column:
    return F.replace(text, F.lit(REPLACEMENT), F.lit(""))


def drop_placeholders(text: Column) -> Column:
    dropped = F.regexp_replace(text, PLACEHOLDER, "")
    return F.when(F.contains(text, F.lit("**==> picture [")), dropped).otherwise(text)


def rstrip_lines(text: Column) -> Column:
    """Strip blanks and tabs before every line end."""
    return on_lines(text, rstrip_each)


def final_newline(text: Column) -> Column:
    """Exactly one newline at the end."""
    bare = F.when(text.endswith("\n"), on_lines(text, drop_last_blank)).otherwise(text)
    return F.concat(bare, F.lit("\n"))


def cleanup(text: Column) -> Column:
    """All steps in order. Not idempotent, so apply it once.

    The steps after the headers share one split into lines. What a step looks for is searched in
    the whole text first: that is a compiled scan, while the steps are interpreted line by line.
    """

    def tail(t: Column) -> Column:
        def has(*marks: str) -> Column:
            return reduce(lambda a, b: a | b, (F.contains(t, F.lit(m)) for m in marks))

        def if_needed(needed: Column, step: Callable[[Column], Column]) -> Callable[[Column], Column]:
            return lambda lines: F.when(needed, step(lines)).otherwise(lines)

        padded = has(" \n", "\t\n") | t.endswith(" ") | t.endswith("\t")
        hashed = t.startswith("#") | has("\n#")
        return _chain(
            lines_of(t),
            if_needed(padded, rstrip_each),
            # lines of blanks become empty ones in the step before
            if_needed(has("\n\n\n") | padded, collapse_blank),
            if_needed(hashed, compress_in),
            if_needed(has("|"), repair_in),
            drop_last_blank,
        )

    cleaned = _chain(
        drop_replacement_char(text), drop_placeholders, convert_picture_blocks, dedupe_headers, tail
    )
    return F.concat(F.array_join(cleaned, "\n"), F.lit("\n"))


def _chain(value: Column, *steps) -> Column:
    """Apply the steps one after the other, each on the bound result of the one before."""
    if not steps:
        return value
    return let(value, lambda bound: _chain(steps[0](bound), *steps[1:]))
