"""Packing of paragraph rows against packing inside a row, for every run length."""

import random

import pytest
from pyspark.sql import functions as F
from test_functions import random_texts

from foliomark.functions import chunks
from foliomark.operators import long_chunks
from foliomark.operators.long_documents import lines_of_parts


def paragraphs_of(spark, texts):
    rows = [(k, i, p) for k, t in enumerate(texts) for i, p in enumerate(t.split("\n\n"))]
    return spark.createDataFrame(rows, "doc_id long, para_no int, paragraph string").repartition(8)


def in_rows(spark, texts, limit):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return {r.i: list(r.c) for r in df.select("i", chunks.chunk_pack(F.col("text"), limit).alias("c")).collect()}


def packed(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.doc_id, r.chunk_no)):
        assert r.chunk_no == len(out.setdefault(r.doc_id, []))
        out[r.doc_id].append(r.chunk)
    return out


@pytest.mark.parametrize(("span", "limit"), [(1, 12), (2, 40), (3, 5), (7, 60), (1000, 25)])
def test_same_chunks_as_in_a_row(spark, span, limit):
    texts = [*random_texts(150, seed=limit), "a\n\n" * 50, "x" * 100 + "\n\ny", "\n\n\n\n", "a\n\nb\n\n\nc"]
    found = packed(long_chunks.pack_paragraphs(paragraphs_of(spark, texts), limit, span))
    assert found == in_rows(spark, texts, limit)


def test_one_document_over_many_tasks(spark):
    rng = random.Random(3)
    big = "\n\n".join("w" * rng.choice([0, 1, 5, 40, 300]) for _ in range(6000))
    texts = [big, "small\n\none"]
    found = packed(long_chunks.pack_paragraphs(paragraphs_of(spark, texts), 200, span=64))
    assert found == in_rows(spark, texts, 200)


def test_paragraphs_of_lines(spark):
    texts = [*random_texts(200, seed=11), "\n\n\n", "\n\n\n\n\n", "a\n\n\n\nb", "\na\n\n\n", "a\n\n\n\n\n"]
    parts = spark.createDataFrame([(k, 0, t) for k, t in enumerate(texts)], "doc_id long, part_no int, text string")
    for span in (1, 3, 1000):
        rows = long_chunks.paragraph_rows(lines_of_parts(parts), span).collect()
        found = {}
        for r in sorted(rows, key=lambda r: (r.doc_id, r.para_no)):
            assert r.para_no == len(found.setdefault(r.doc_id, []))
            found[r.doc_id].append(r.paragraph)
        wrong = [(t, found[k]) for k, t in enumerate(texts) if found[k] != t.split("\n\n")]
        assert not wrong, wrong[:3]


def test_no_paragraphs(spark):
    assert long_chunks.pack_paragraphs(paragraphs_of(spark, ["a"]).limit(0)).count() == 0
