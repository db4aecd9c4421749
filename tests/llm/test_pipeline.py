"""The pipeline against plain statements of its stages, and its queries against their SQL."""

from __future__ import annotations

from pathlib import Path

import duckdb
import public_tokenizers
import pytest
from brute import contaminated, entities, jaccard_components
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from foliomark.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    docs = sorted((r.doc_id, r.text) for r in table.select("doc_id", "text").collect())
    with_letters = [d for d in docs if d[1] and any(c.isalpha() for c in d[1])]
    unique = [d for d, (_, _, root) in zip(with_letters, jaccard_components(with_letters), strict=True) if d[0] == root]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = [d for d, row in zip(unique, contaminated(unique, items), strict=True) if not row[2]]
    pieces = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in pieces} == {i for i, _ in clean}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sizes = {r.doc_id: r.doc_tokens for r in pieces}
    for i, text in clean:
        if not entities(text) and not any(c.isdigit() for c in text):
            assert sizes[i] == len(library.encode(text, add_special_tokens=False).ids) + 1


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES[:-1])
def test_stages_keep_columns_and_odd_rows(spark, tmp_path, name, stage):
    rows = [
        (1, "The house and the garden of them.", "en", None, 5, "a", 1.0),
        (1, "The house and the garden of them.", "en", None, 5, "a", 1.0),
        (2, "Mail me at a@b.org or call +1 (377) 555-0271 now.", "en", "s", None, None, None),
        (None, "Nothing else here but words of a text.", None, None, None, None, None),
    ]
    names = "doc_id long, text string, lang string, source string, n_chars long, row_id string, score double"
    docs = spark.createDataFrame(rows, names)
    empty = spark.createDataFrame([], "item_id long, text string")
    empty.write.parquet(f"{tmp_path}/benchmark.parquet")
    found = stage(spark, docs, str(tmp_path))
    assert found.columns == docs.columns and found.dtypes == docs.dtypes
    assert found.count() == (3 if name == "jaccard_join" else 4)
    assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    if name == "pii":
        text = found.filter("doc_id = 2").first().text
        assert text == "Mail me at [EMAIL] or call [PHONE] now."
        assert found.filter("doc_id = 2").first().n_chars == len(text)


def test_language_drops_texts_without_letters(spark):
    docs = spark.createDataFrame([(1, None, "en"), (2, "12 !", "en"), (3, "words", "en"), (4, "Wörter", "de")], "doc_id long, text string, lang string")
    assert {r.doc_id for r in corpus_pipeline.language(spark, docs, "").collect()} == {3, 4}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_against_sql(spark, tmp_path, name):
    out = str(tmp_path / "out")
    QUERIES[name](spark, SF).write.parquet(out)
    db = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    db.execute(f"CREATE TABLE expected AS {ORACLE[name]}")
    columns = ", ".join(c[0] for c in db.execute("DESCRIBE expected").fetchall())
    db.execute(f"CREATE TABLE found AS SELECT {columns} FROM read_parquet('{out}/*.parquet')")
    for a, b in (("found", "expected"), ("expected", "found")):
        assert db.execute(f"SELECT count(*) FROM (SELECT {columns} FROM {a} EXCEPT ALL SELECT {columns} FROM {b})").fetchone() == (0,)


def test_personal_data_of_documents(spark):
    found = QUERIES["op4_pii"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), "doc_id")
    for r in found.select("text", "spans", "base_sha256", F.sha2(F.lit(""), 256).alias("none")).collect():
        base = entities(r.text)
        assert [s for s in r.spans.split(",") if s and s[:3] != "id:"] == base and (r.base_sha256 == r.none) == (not base)
