"""Plan shapes, and results on data where one key holds a third of all rows."""

import time

import pytest
import spec
from pyspark.sql import functions as F

from foliomark.functions import chunks, tables
from foliomark.operators import chunking, documents, pages
from foliomark.operators.ordered import concat_parts, ordered_concat
from foliomark.plans.convert import ConvertOptions, convert
from foliomark.sources import files, sinks
from foliomark.workload.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return plan(df).count("Exchange ")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "text")


def paged(docs):
    cut = F.transform(F.split("text", "\n"), lambda t, i: F.struct((i + 1).alias("page_no"), t.alias("text")))
    return docs.withColumn("pages", cut)


def test_text_operators_do_not_shuffle(docs):
    identified = paged(docs).withColumns({"stem": F.col("source"), "name": F.col("source"), "path": F.col("source")})
    for df in (
        documents.cleanup(docs), documents.format_documents(docs),
        documents.classify_lines(documents.doc_lines(docs)), documents.table_islands(docs),
        documents.header_levels(docs), documents.fitted_rows(documents.picture_blocks(docs)),
        chunking.chunk_requests(chunking.chunk_documents(docs, 4000), "Tidy."),
        convert(identified, ConvertOptions(tables=False, strip_headers_footers=True)),
    ):
        assert exchanges(df) == 0
        assert "Python" not in plan(df) and "Pandas" not in plan(df)


def test_scan_reads_only_needed_columns(docs):
    shown = plan(documents.classify_lines(documents.doc_lines(docs)))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in shown


def test_running_headers_are_counted_in_the_row(docs):
    assert exchanges(documents.running_headers(docs)) == 0


def test_python_runs_only_in_hooks(docs):
    shown = plan(chunking.map_chunks(chunking.chunk_documents(docs), str))
    assert shown.count("MapInPandas") == 1


def hot_pages(spark, n=30_000):
    """A third of all pages belong to one document; the rest are spread over a thousand."""
    rows = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 1000 + 1).alias("doc_id"),
        F.col("id").cast("int").alias("page_no"),
        F.concat(F.lit("Top\nline "), F.col("id").cast("string"), F.lit("\nPage "), F.col("id").cast("string")).alias("text"),
    )
    return rows.repartition(8, F.rand(1))


def test_hot_document_assembles_in_parts(spark):
    rows = hot_pages(spark)
    parts = concat_parts(rows, ["doc_id"], "page_no", span=1024)
    biggest = parts.agg(F.max(F.size(F.split("text", "\n")) / 3)).first()[0]
    assert biggest <= 1024
    whole = ordered_concat(rows, ["doc_id"], "page_no", span=1024).where("doc_id = 0").first().text
    assert whole.split("\n")[1::3] == [f"line {i}" for i in range(0, 30_000, 3)]


def test_hot_document_edges(spark):
    rows = hot_pages(spark)
    stripped = pages.strip_page_table(rows, span=64)
    seen = stripped.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(F.col("text").rlike("Top|Page")).alias("bad"))
    assert seen.agg(F.sum("n"), F.sum("bad")).first() == (30_000, 0)
    hot = stripped.where("doc_id = 0").orderBy("page_no")
    assert [r.text for r in hot.collect()] == [f"line {i}" for i in range(0, 30_000, 3)]


def test_hot_output_path(spark):
    claims = spark.range(3_000).select(
        F.format_string("/in/%05d.pdf", "id").alias("path"),
        F.when(F.col("id") % 3 == 0, F.lit("/out/hot.md")).otherwise(F.format_string("/out/%d.md", "id")).alias("out_path"),
    )
    marked = sinks.mark_superseded(claims)
    assert marked.count() == 3_000
    kept = marked.where("not superseded").groupBy("out_path").count()
    assert kept.agg(F.max("count"), F.count("*")).first() == (1, 2_001)
    assert marked.where("out_path = '/out/hot.md' and not superseded").first().path == "/in/02997.pdf"
    assert sinks.path_collisions(claims).collect()[0][:] == ("/out/hot.md", 1000, "/in/02997.pdf")


def test_hot_page_images(spark):
    page = spark.createDataFrame([(1, 1, "t"), (1, 2, "u")], "doc_id long, page_no int, text string")
    images = spark.range(1, 2001).select(
        F.lit(1).cast("long").alias("doc_id"), F.lit(1).alias("page_no"), F.col("id").cast("int").alias("img_no"),
        F.when(F.col("id") != 7, F.lit(b"x")).alias("content"),
    )
    out = {r.page_no: r.text for r in pages.attach_images(page, images, F.lit("images/d"), span=100).collect()}
    numbers = [i for i in range(1, 2001) if i != 7]
    links = [f"\n![page_1_img_{i}.png](images/d/page_1_img_{i}.png)\n" for i in numbers]
    assert out == {1: "\n".join(["t", *links]), 2: "u"}


def test_long_document(spark):
    """One document as large as a whole corpus stays linear in every step."""
    block = "\n".join(["# **Run**", "## A", "", "## **A**", "text  ", "", "", "", "| a | b |", "| c | d |", "#### deep"])
    text = "\n".join([block] * 4000) + "\n" * 5000 + " " * 20000 + "x" + "#" * 50
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert documents.cleanup(docs).first().text == spec.cleanup(text)


def test_unclosed_blocks_stay_linear(spark):
    text = (spec.START + "a  b<br>\n") * 3000 + spec.END + (spec.START + "c  d<br>\n") * 3000
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert documents.cleanup(docs).first().text == spec.cleanup(text)


def test_null_and_empty_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "\n\n\n\n")], "doc_id long, text string")
    assert [r.text for r in documents.cleanup(docs).orderBy("doc_id").collect()] == [None, "\n", "\n"]
    assert documents.doc_lines(docs).count() == 1 + 5
    assert chunking.chunk_documents(docs, 2).groupBy("doc_id").count().count() == 2


def test_computed_arrays_are_evaluated_once(spark, docs):
    """No inferred size filter repeats the work of an exploded array."""
    assert "Filter (size(" not in plan(documents.picture_blocks(docs))


def test_corpus_table_round_trip(spark, docs, tmp_path):
    sinks.write_corpus(documents.cleanup(docs), str(tmp_path / "corpus"))
    assert spark.read.parquet(str(tmp_path / "corpus")).count() == docs.count()


@pytest.mark.parametrize("name", ["cleanup", "running_headers", "format_text", "chunk_documents", "classify_lines"])
def test_registered_document_queries_do_not_shuffle(spark, name):
    assert exchanges(QUERIES[name](spark, "/root/testdata/sf0.001")) == 0


def seconds(df):
    started = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def test_packing_chunks_is_linear(spark):
    def run(n):
        text = F.concat_ws("\n\n", F.array_repeat(F.lit("abcdefghij"), n))
        return seconds(spark.range(1).select(F.size(chunks.chunk_pack(text, 12)).alias("n")))

    run(1000)
    small, large = run(50_000), run(200_000)
    assert large < 4 * 2 * small + 2


def test_unclosed_picture_starts_are_linear(spark):
    def run(n):
        text = F.concat(F.lit(tables.BLOCK_END), F.repeat(F.lit(tables.BLOCK_START + "x "), F.lit(n)))
        return seconds(spark.range(1).select(F.size(tables.picture_blocks(text)).alias("n")))

    run(100)
    small, large = run(4000), run(16_000)
    assert large < 4 * 2 * small + 2


def test_identity_on_windows_of_names(spark):
    df = spark.createDataFrame([("s3a://b/x/y/in.put.pdf",)], ["path"])
    row = files.with_identity(df).first()
    assert (row["name"], row["stem"], row["out_path"]) == ("in.put.pdf", "in.put", "s3a://b/x/y/in.put.md")
