"""Line classification: what a raw line is and its Markdown form. First match wins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliomark.functions.text import WS, collapse_blank, is_upper, let, lines_of, strip, title

# Characters that open a bullet, and the exclusive length limit of a heading.
BULLETS = ["•", "·", "-", "*", "◦"]
HEADING_LIMIT = 60


def is_caps_heading(line: Column) -> Column:
    # The cheap length test comes first, so long lines never reach a regex.
    return (F.length(line) < HEADING_LIMIT) & is_upper(line)


def caps_heading(line: Column) -> Column:
    return F.concat(F.lit("## "), title(line))


def is_bullet(line: Column) -> Column:
    return F.left(line, F.lit(1)).isin(BULLETS)


def bullet(line: Column) -> Column:
    return F.concat(F.lit("- "), strip(F.substr(line, F.lit(2))))


def is_numbered(line: Column) -> Column:
    return line.rlike(rf"(?U)^\d+[.)][{WS}]")


def line_kind(line: Column) -> Column:
    """Kind of a stripped line: blank, heading, bullet, numbered or paragraph."""
    return (
        F.when(line == "", "blank")
        .when(is_caps_heading(line), "heading")
        .when(is_bullet(line), "bullet")
        .when(is_numbered(line), "numbered")
        .otherwise("paragraph")
    )


def line_markdown(line: Column, kind: Column | None = None) -> Column:
    """Markdown of a stripped line; pass ``kind`` when it is already computed."""
    heading = is_caps_heading(line) if kind is None else kind == "heading"
    item = is_bullet(line) if kind is None else kind == "bullet"
    return F.when(heading, caps_heading(line)).when(item, bullet(line)).otherwise(line)


def format_text(text: Column) -> Column:
    """Classify and rewrite every line of a text, then collapse blank lines."""
    stripped = F.transform(lines_of(text), strip)
    rewritten = F.transform(stripped, lambda line: line_markdown(line))
    return F.array_join(let(rewritten, collapse_blank), "\n")
