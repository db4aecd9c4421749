"""Ordered concatenation of rows into texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rows joined by one first-level group.
SPAN = 1024

Carried = Callable[[str], Column]


def _in_order(ordinal: str, text: str, sep: str) -> Column:
    rows = F.sort_array(F.collect_list(F.struct(ordinal, text)))
    return F.array_join(F.transform(rows, lambda r: F.coalesce(r[text], F.lit(""))), sep)


def concat_parts(
    df: DataFrame, keys: list[str], ordinal: str, text: str = "text", sep: str = "\n",
    span: int = SPAN, carry: dict[str, Carried] | None = None,
) -> DataFrame:
    """One row per key and run of ``span`` ordinals: ``keys, part_no, text``.

    No group is larger than ``span`` ordinals, whatever share of the rows a key holds. The
    parts of a key joined by ``sep`` in order are its whole text. ``carry`` names further
    columns with an aggregate that may be applied in steps (sum, max, ...).
    """
    carry = carry or {}
    part = F.floor(F.col(ordinal) / span).cast("long").alias("part_no")
    return (
        df.select(*keys, part, ordinal, text, *carry)
        .groupBy(*keys, "part_no")
        .agg(_in_order(ordinal, text, sep).alias(text), *[f(c).alias(c) for c, f in carry.items()])
    )


def ordered_concat(
    df: DataFrame, keys: list[str], ordinal: str, text: str = "text", sep: str = "\n",
    span: int = SPAN, carry: dict[str, Carried] | None = None,
) -> DataFrame:
    """One row per key with its texts joined in ordinal order.

    Two levels: the rows of a large key are sorted and joined by many tasks, and the last
    task joins one string per ``span`` rows. A result is one string, so a key whose text
    exceeds a row (2 GB) must stay with ``concat_parts``.
    """
    parts = concat_parts(df, keys, ordinal, text, sep, span, carry)
    whole = _in_order("part_no", text, sep).alias(text)
    return parts.groupBy(*keys).agg(whole, *[f(c).alias(c) for c, f in (carry or {}).items()])
