"""Noisy Markdown derived from the given tables by a fixed rule.

The given texts have no headers, tables or blank lines, so every text is dressed up first:
each line gets one of thirteen treatments by position. No text is cut away; where a
treatment needs a short heading, the rest of the line follows on the next line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomark.functions.tables import BLOCK_END, BLOCK_START
from foliomark.functions.text import let, lines_of
from foliomark.operators.built import built

PAGE_LINES = 4
PLACEHOLDER_LINE = "**==> picture [12 x 34] intentionally omitted <==**"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    wanted = columns or ("doc_id", "source", "text")
    return table(spark, sf_dir, "documents").select(*wanted)


def _first(line: Column, n: int) -> Column:
    return F.left(line, F.lit(n))


def _rest(line: Column, n: int) -> Column:
    return F.substr(line, F.lit(n + 1))


def noisy_item(line: Column, i: Column, doc_id: Column, source: Column) -> Column:
    h = (doc_id * 7 + i) % 13
    size = F.length(line).cast("string")
    lit = F.lit
    plain = F.replace(line, lit("|"), lit(""))
    shout = F.upper(F.replace(_first(line, 40), lit("ß"), lit("ss")))
    body = (
        F.when(h == 0, line)
        .when(h == 1, F.concat(lit("### "), _first(line, 30), lit("  \n"), _rest(line, 30)))
        .when(h == 2, F.concat(shout, lit("\n"), _rest(line, 40)))
        .when(h == 3, F.concat(lit("• "), line))
        .when(h <= 5, F.concat(lit("| "), plain, lit(" | "), size, lit(" |")))
        .when(h <= 8, F.concat(line, lit("\n\n\n")))
        .when(h == 9, F.concat(lit(PLACEHOLDER_LINE + "\n"), line))
        .when(h == 10, F.concat(lit("\ufffd"), line, lit("\ufffd \t")))
        .when(
            h == 11,
            F.concat(
                lit("## "), _first(line, 20), lit("\n\n## **"), _first(line, 20), lit("**\n"),
                _rest(line, 20),
            ),
        )
        .otherwise(
            F.concat(
                lit(BLOCK_START + "Name  Qty  Note<br>\nx  1  y<br>\nz  2  w<br>\n"),
                line, lit("  "), size, lit("<br>\na  b  c  d<br>\n" + BLOCK_END),
            )
        )
    )
    running = F.when(i % PAGE_LINES == 0, F.concat(lit("# **"), source, lit("**\n"))).otherwise("")
    bare = F.when((doc_id % 17 == 0) & (i == 3), "##\n").otherwise("")
    return F.concat(running, bare, body)


def _items(text: Column) -> Column:
    return F.transform(
        lines_of(text), lambda x, i: noisy_item(x, i, F.col("doc_id"), F.col("source"))
    )


def noisy_text(text: Column) -> Column:
    return F.array_join(_items(text), "\n")


def noisy_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return docs.select("doc_id", "source", built(spark, noisy_text, "text").alias("text"))


def _paged(text: Column) -> Column:
    return let(_items(text), _cut_pages)


def _cut_pages(items: Column) -> Column:
    last = F.floor((F.size(items) - 1) / PAGE_LINES).cast("int") + 1

    def page(p: Column) -> Column:
        body = F.array_join(F.slice(items, (p - 1) * PAGE_LINES + 1, F.lit(PAGE_LINES)), "\n")
        footer = F.concat(F.lit("\nPage "), p.cast("string"), F.lit("\n"))
        return F.struct(p.alias("page_no"), F.concat(body, footer).alias("text"))

    return F.transform(F.sequence(F.lit(1), last), page)


def noisy_paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages array<struct<page_no, text>>`` with a running header and a page-number footer."""
    docs = documents(spark, sf_dir)
    return docs.select("doc_id", "source", built(spark, _paged, "text").alias("pages"))
