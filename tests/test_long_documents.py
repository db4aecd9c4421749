"""Documents as tables of lines, cut at every run length, against whole texts."""

import random

import pytest
import spec
from pyspark.sql import functions as F
from test_functions import POOL, random_texts

from foliomark.operators import long_documents as long
from foliomark.operators.scans import Running, running
from foliomark.operators.spool import Scratch

HARD = [
    "**==> picture [1 x 2] intentionally omitted <==**==> picture [3 x 4] intentionally omitted <==**\nnext",
    "a **==> picture [1 x 2] intentionally omitted <==**\n**==> picture [1 x 2] intentionally omitted <==**\n**==> picture [9 x 9] intentionally omitted <==**",
    "p**----- Start of picture text -----**<br>\na  b<br>x\ny  c<br>**----- End of picture text -----**<br>tail**----- Start of picture text -----**<br>\n<br>**----- End of picture text -----**<br>end",
    "**----- Start of picture text -----**<br>\n**----- Start of picture text -----**<br>\na  1<br>\n**----- End of picture text -----**<br>**----- End of picture text -----**<br>",
    "**----- End of picture text -----**<br>**----- Start of picture text -----**<br>\nnever closed  x",
    "**----- Start of picture text -----**<br>\nx  " + "y<br>\nx  " * 40 + "**----- End of picture text -----**<br>",
    "# A\n\n \n## **A**\ntext\n# A", "# R\na\n# R\n# S\n# R\n# S", "##\n##\n##\n#### x", "###### a\n##", "# a\n### b\n#",
    "| a |\n| b |\n| c |", "||\n||", "x\n\n\n\n", "\n\n\n\n", " \n\t\n ",
]


def lines_table(spark, texts):
    rows = [(k, i, line) for k, t in enumerate(texts) for i, line in enumerate(t.split("\n"))]
    return spark.createDataFrame(rows, "doc_id long, line_no long, line string").repartition(5)


def joined(lines):
    out = {}
    for r in sorted(lines.collect(), key=lambda r: (r.doc_id, r.line_no)):
        assert r.line_no == len(out.setdefault(r.doc_id, []))
        out[r.doc_id].append(r.line)
    return {k: "\n".join(v) for k, v in out.items()}


@pytest.mark.parametrize("span", [1, 2, 3, 8, 1000])
def test_cleanup_of_lines(spark, span):
    texts = HARD + random_texts(250, seed=span)
    found = joined(long.cleanup_lines(lines_table(spark, texts), span))
    wrong = [(t, found[k] + "\n", spec.cleanup(t)) for k, t in enumerate(texts) if found[k] + "\n" != spec.cleanup(t)]
    assert not wrong, (len(wrong), wrong[:2])


def test_one_document_over_many_runs(spark):
    """One document of most lines, with headers, blocks and tables that go on over many runs."""
    rng = random.Random(9)
    block = ["**----- Start of picture text -----**<br>", *["a  b  c<br>", "d  e<br>"] * 300, "**----- End of picture text -----**<br>"]
    big = []
    for _ in range(60):
        big += rng.choice([block, ["# Page", ""], ["| a | b |"] * 90, [""] * 70, rng.sample(POOL, 12), ["##"] * 3, ["### deep"]])
    texts = ["\n".join(big), "short"]
    lines = lines_table(spark, texts)
    scratch = Scratch(spark, "test")
    found = joined(long.cleanup_lines(lines, 64, scratch))
    assert found[0] + "\n" == spec.cleanup(texts[0]) and found[1] == "short"
    scratch.release()


def test_parts_become_lines_and_back(spark):
    texts = random_texts(60, seed=4)
    rng = random.Random(1)
    rows = []
    for k, t in enumerate(texts):
        cuts = t.split("\n")
        no = 0
        while cuts:
            n = rng.randint(1, 5)
            rows.append((k, no, "\n".join(cuts[:n])))
            cuts, no = cuts[n:], no + 1
    parts = spark.createDataFrame(rows, "doc_id long, part_no int, text string")
    lines = long.lines_of_parts(parts, span=2)
    assert joined(lines) == dict(enumerate(texts))
    again = long.parts_of_lines(lines, span=3).groupBy("doc_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part_no", "text"))), lambda p: p["text"]), "\n").alias("text")
    )
    assert {r.doc_id: r.text for r in again.collect()} == dict(enumerate(texts))
    assert long.cleanup_lines(lines.limit(0)).count() == 0


@pytest.mark.parametrize("span", [1, 3, 100])
def test_running_values(spark, span):
    rng = random.Random(span)
    rows = [(k, i, rng.choice([None, None, rng.randint(0, 9)])) for k in range(4) for i in range(rng.randint(1, 30))]
    df = spark.createDataFrame(rows, "k long, i long, v long")
    values = [Running("s", F.col("v"), "sum"), Running("l", F.col("v")), Running("n", F.col("v"), after=True), Running("r", F.col("v"), "sum", after=True)]
    for r in running(df, "k", ["i"], values, span).collect():
        before = [v for k, i, v in rows if k == r.k and i < r.i and v is not None]
        behind = [v for k, i, v in rows if k == r.k and i > r.i and v is not None]
        assert (r.s, r.l, r.n, r.r) == (sum(before), before[-1] if before else None, behind[0] if behind else None, sum(behind))
