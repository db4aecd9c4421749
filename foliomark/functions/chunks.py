"""Paragraph-aligned chunks of a text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliomark.functions.text import let

# Default chunk limit in characters and the paragraph break.
CHUNK_LIMIT = 80_000
BREAK = "\n\n"


def paragraphs(text: Column) -> Column:
    return F.split(text, BREAK)


# Paragraphs of one inner fold; its starts are appended to an array of at most this size.
FOLD = 512


def chunk_starts(sizes: Column, limit: int) -> Column:
    """Indexes of the paragraphs that open a chunk (greedy packing).

    A fold copies its state at every step, so it goes in two levels: the inner one collects the
    starts of ``FOLD`` paragraphs, the outer one those lists, and the work stays linear.
    """

    def step(s: Column, n: Column) -> Column:
        overflow = (s["at"] > 0) & (s["size"] + n > limit)
        return F.struct(
            (s["at"] + 1).alias("at"),
            F.when(overflow, n.cast("long")).otherwise(s["size"] + n).alias("size"),
            F.when(overflow, F.concat(s["starts"], F.array(s["at"])))
            .otherwise(s["starts"])
            .alias("starts"),
        )

    def outer(s: Column, some: Column) -> Column:
        begin = F.struct(s["at"].alias("at"), s["size"].alias("size"), F.array().cast("array<int>").alias("starts"))
        return let(
            F.aggregate(some, begin, step),
            lambda inner: F.struct(
                inner["at"].alias("at"),
                inner["size"].alias("size"),
                F.concat(s["lists"], F.array(inner["starts"])).alias("lists"),
            ),
        )

    last = F.floor((F.size(sizes) - 1) / FOLD).cast("int")
    folds = F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(sizes, k * FOLD + 1, F.lit(FOLD)))
    start = F.struct(
        F.lit(0).alias("at"), F.lit(0).cast("long").alias("size"), F.array(F.array(F.lit(0))).alias("lists")
    )
    return F.aggregate(folds, start, outer, lambda s: F.flatten(s["lists"]))


def chunk_pack(text: Column, limit: int) -> Column:
    """Greedy packing; a paragraph counts its length + 2, an oversize one stays whole."""

    def cut(parts: Column) -> Column:
        sizes = F.transform(parts, lambda p: F.length(p) + len(BREAK))

        def slices(starts: Column) -> Column:
            ends = F.concat(F.slice(starts, F.lit(2), F.size(starts) - 1), F.array(F.size(parts)))
            return F.zip_with(
                starts, ends, lambda s, e: F.array_join(F.slice(parts, s + 1, e - s), BREAK)
            )

        return let(chunk_starts(sizes, limit), slices)

    return let(paragraphs(text), cut)


def chunks(text: Column, limit: int = CHUNK_LIMIT) -> Column:
    """``array<string>``: the text itself when it fits, else its packed chunks."""
    return F.when(F.length(text) <= limit, F.array(text)).otherwise(chunk_pack(text, limit))
