"""Column functions against the single-text statements, on literals and random texts."""

import random

import pytest
import spec
from pyspark.sql import functions as F

from foliomark.functions import chunks, cleanup, headers, lines, tables, text

POOL = [
    "", "", "", " ", "\t", "plain text", "plain text  \t", "# **Src**", "# Src", "## S R C", "### src",
    "#   ", "# **", "#", "##", "###", "####### seven", "##\tTab head", "# Nbsp", "# A", "## A", "# B",
    "#### Deep", "###### Deepest", "| a | b |", "|---|---|", "|  |  |", "| a |", "|---|", "|", "||",
    " | x | y | ", " | n |\x1c", "| a", "a |", "|:-:|--:|", "| - | x |", "- ABC", "IT'S A-B", "---",
    "•", "• item", "*bold*", "1. one", "2) two", "3.x", "٣. arabic", "ÀÉ ÖÜ", "ǅ", "ªBC", "Ⅷ", "ⒶB",
    "A" * 59, "A" * 60, "x\rABC", "ABC\r", "\x1cABC\x85", "�repl�", "�",
    "**==> picture [12 x 34] intentionally omitted <==**",
    "pre **==> picture [1 x 2] intentionally omitted <==** post",
    "**----- Start of picture text -----**<br>", "**----- End of picture text -----**<br>",
    "Name  Qty  Note<br>", "x  1  y<br>", "z  2<br>", "a  b  c  d<br>", "word<br>", "<br>", "p  q<br> <br>r  s",
    "𝒳 astral", "ß straße", "İX", "é" * 30, "ΟΔΟΣ", "ΑΣ'Α ΣΑΣ", "ǄUNGLA",
]

BLOCK = ["**----- Start of picture text -----**<br>", "Name  Qty  Note<br>", "x  1  y<br>", "w<br>",
         "a  b  c  d<br>", "**----- End of picture text -----**<br>"]


def random_texts(n, seed=7):
    rng = random.Random(seed)
    out = ["", "\n", "\n\n\nabc", "# A\n\n# A", "##\n### x\n# y", "# H\n# H\nt\n# A\n\n# H\n# A"]
    for _ in range(n):
        small = rng.sample(POOL, rng.randint(2, 12))
        parts = []
        for _ in range(rng.randint(0, 25)):
            parts += BLOCK[: rng.choice([6, 6, 5])] if rng.random() < 0.08 else [rng.choice(small)]
        out.append("\n".join(parts))
    return out


@pytest.fixture(scope="module")
def texts(spark):
    data = random_texts(3000)
    df = spark.createDataFrame(list(enumerate(data)), "i int, text string").repartition(8).cache()
    df.count()
    return data, df


def compare(texts, column, expected):
    data, df = texts
    got = {r.i: r.out for r in df.select("i", column(F.col("text")).alias("out")).collect()}
    wrong = [(data[i], got[i], expected(data[i])) for i in range(len(data)) if got[i] != expected(data[i])]
    assert not wrong, (len(wrong), wrong[:3])


@pytest.mark.parametrize(
    "column, expected",
    [
        (lines.format_text, spec.format_text),
        (tables.convert_picture_blocks, spec.pictures),
        (headers.keep_first_running, spec.first_running),
        (headers.dedupe_headers, spec.headers),
        (headers.header_levels, spec.levels),
        (headers.compress_levels, spec.compress),
        (tables.repair_tables, spec.repair),
        (cleanup.drop_placeholders, spec.placeholders),
        (cleanup.rstrip_lines, spec.strip_ends),
        (text.collapse_newlines, spec.squeeze),
        (cleanup.final_newline, lambda t: t.rstrip("\n") + "\n"),
        (cleanup.cleanup, spec.cleanup),
    ],
    ids=lambda f: getattr(f, "__name__", "f"),
)
def test_matches_statement(texts, column, expected):
    compare(texts, column, expected)


@pytest.mark.parametrize("limit", [12, 60, 120])
def test_chunks_are_packed(texts, limit):
    data, df = texts
    found = df.select("i", chunks.chunk_pack(F.col("text"), limit).alias("packed"), chunks.chunks(F.col("text"), limit).alias("c"))
    for r in found.collect():
        assert spec.well_packed(data[r.i], r.packed, limit), data[r.i]
        assert list(r.c) == ([data[r.i]] if len(data[r.i]) <= limit else list(r.packed))
