"""Profiles that add up, hooks as table functions in SQL text, and counts observed while writing."""

import time
from collections import Counter

import pytest
import spec
from pyspark.sql import functions as F
from test_functions import random_texts

from foliomark.functions import hooks
from foliomark.operators import profile
from foliomark.operators.calls import TIME_OUT
from foliomark.sources import sinks


def stages(t):
    yield t
    t = spec.placeholders(t.replace("�", ""))
    yield t
    for step in (spec.pictures, spec.headers, lambda x: spec.squeeze(spec.strip_ends(x)), spec.compress, spec.repair, lambda x: x.rstrip("\n") + "\n"):
        t = step(t)
        yield t


def test_profiles_of_texts(spark):
    texts = [*random_texts(300, seed=2), None]
    df = spark.createDataFrame([(k, t, "s" if k % 3 else None) for k, t in enumerate(texts)], "doc_id int, text string, source string")
    rows = profile.structure_profile(df.repartition(4)).collect()
    for r in rows:
        text = texts[r.doc_id] or ""
        lines = text.split("\n")
        kinds = Counter(spec.kind(x.strip()) for x in lines)
        assert (r.n_chars, r.n_lines) == (len(text), len(lines))
        assert {k: r[f"n_{k}"] for k in profile.KINDS} == {k: kinds[k] for k in profile.KINDS}
        assert r.n_headers == sum(spec.header(x) is not None for x in lines)
        sizes = [len(t) for t in stages(text)]
        assert [r[f"removed_{n}"] for n, _ in profile.STEPS] == [a - b for a, b in zip(sizes, sizes[1:])]
        assert r.n_chars - sum(r[f"removed_{n}"] for n, _ in profile.STEPS) == len(spec.cleanup(text))
    whole = profile.profile_totals(profile.structure_profile(df, "source"), "source").collect()
    assert {r.source: r.n_docs for r in whole} == Counter("s" if k % 3 else None for k in range(len(texts)))
    assert sum(r.n_lines for r in whole) == sum(r.n_lines for r in rows)


def test_no_shuffle_in_a_profile(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id int, text string")
    shown = profile.structure_profile(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in shown and "Python" not in shown


def make_parser():
    def parse(content):
        if content == b"hang":
            time.sleep(600)
        if content == b"odd":
            return [{"text": 5}]
        return [{"text": t, "tables": [[["a", None]]], "images": [b"i", None]} for t in content.decode().split("|")]

    return parse


def test_a_parser_in_sql(spark):
    hooks.register_parser(spark, "parse_it", make_parser(), seconds=1.0)
    rows = [(k, c) for k, c in enumerate([b"x|y", b"", b"odd", b"hang", None, b"z"])]
    spark.createDataFrame(rows, "id int, content binary").coalesce(1).createOrReplaceTempView("raw_files")
    found = spark.sql("SELECT r.id, p.* FROM raw_files r, LATERAL parse_it(r.content) p ORDER BY id, page_no").collect()
    assert [(r.id, r.page_no, r.text, r.error) for r in found] == [
        (0, 1, "x", None), (0, 2, "y", None), (1, 1, "", None), (2, None, None, "TypeError: the text of page 1 is int, not str"),
        (3, None, None, TIME_OUT), (4, None, None, "ValueError: no content"), (5, 1, "z", None),
    ]
    assert found[0].tables == [[["a", ""]]] and [bytes(i) if i is not None else None for i in found[0].images] == [b"i", None]


def test_a_transform_in_sql(spark):
    def transform(text):
        return 5 if text == "odd" else text.upper()

    hooks.register_transform(spark, "shout_it", transform)
    spark.createDataFrame([("a",), ("odd",), (None,)], "t string").createOrReplaceTempView("said")
    found = {r.t: (r.result, r.error) for r in spark.sql("SELECT s.t, x.* FROM said s, LATERAL shout_it(s.t) x").collect()}
    assert found == {"a": ("A", None), "odd": (None, "TypeError: the transform gave int, not str"), None: (None, "ValueError: no text")}


@pytest.mark.parametrize("with_error", [True, False])
def test_counts_are_observed_while_writing(spark, tmp_path, with_error):
    calls = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            calls.add(len(b))
            yield b

    docs = spark.range(50).select(F.col("id").cast("string").alias("out_path"), F.when(F.col("id") % 5 == 0, "bad").alias("error"))
    docs = docs.mapInPandas(count, docs.schema)
    got = sinks.write_corpus(docs if with_error else docs.drop("error"), str(tmp_path / "c"))
    assert got == ({"written": 40, "failed": 10} if with_error else {"written": 50, "failed": 0})
    assert calls.value == 50 and spark.read.parquet(str(tmp_path / "c")).count() == 50
    assert sinks.write_corpus(docs.limit(0), str(tmp_path / "c")) == {"written": 0, "failed": 0}
