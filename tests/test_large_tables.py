"""Queries over tables as they come at size: folders of parts."""

import time

import pyarrow as pa
from pyspark.sql import GroupedData
from pyspark.sql import functions as F

from foliomark.operators import chunking, long_chunks, long_documents
from foliomark.operators.calls import TIME_OUT, Calls
from foliomark.operators.spool import Scratch
from foliomark.workload import queries
from foliomark.workload.queries import QUERIES

DOCS = "doc_id long, text string, source string"


def stored(spark, folder, rows, parts=3):
    spark.createDataFrame(rows, DOCS).repartition(parts, F.col("doc_id")).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_stream_over_a_table_of_parts(spark, tmp_path):
    rows = [(k, f"text {k}\n\nmore", f"src{k % 3}") for k in range(30)]
    sf_dir = stored(spark, tmp_path, rows)
    found = {r.doc_id: r.text for r in QUERIES["incremental_cleanup"](spark, sf_dir).collect()}
    assert found == {r.doc_id: r.text for r in QUERIES["cleanup"](spark, sf_dir).collect()}
    assert len(found) == 30


def test_chunk_heads_have_no_cost_for_each_group(spark, monkeypatch):
    """A run of paragraphs is a row: groups of pandas cost a millisecond each, and runs are many."""
    monkeypatch.setattr(GroupedData, "applyInPandas", None)
    rows = [(d, i, "word " * (i % 7)) for d in range(3) for i in range(50)]
    paragraphs = spark.createDataFrame(rows, "doc_id long, para_no int, paragraph string")
    found = long_chunks.pack_paragraphs(paragraphs, 60, span=4).collect()
    texts = {d: [p for e, _, p in rows if e == d] for d in range(3)}
    for d, parts in texts.items():
        assert "\n\n".join(r.chunk for r in sorted(found, key=lambda r: r.chunk_no) if r.doc_id == d) == "\n\n".join(parts)
    assert all(len(r.chunk) <= 60 for r in found)


def test_small_files_take_the_disk_of_a_portion_only(spark, tmp_path, monkeypatch):
    """Every image is read back, and no more than a portion's files are there at a time."""
    rows = [(k, "\n".join(f"line {k} {i}" for i in range(1 + k % 9)), f"src{k % 3}") for k in range(60)]
    sf_dir = stored(spark, tmp_path, rows)
    monkeypatch.setattr(queries, "PORTION_BYTES", 1 << 18, raising=False)
    most, export = [], queries.export_documents

    def watched(docs, manifest):
        done = export(docs, manifest)
        most.append(done.count())
        return done

    monkeypatch.setattr(queries, "export_documents", watched)
    images = QUERIES["exported_images"](spark, sf_dir).collect()
    want = sorted(line for _, text, _ in rows for line in text.split("\n"))
    assert sorted(r.content for r in images) == want and len({r.rel_path for r in images}) == len(want)
    assert len(most) > 3 and max(most) < sum(most) / 2 and sum(most) == len(want) + 60
    assert QUERIES["exported_manifest"](spark, sf_dir).groupBy("kind", "status").count().orderBy("kind").collect() == [
        ("image", "written", len(want)), ("text", "written", 60)
    ]


def test_calls_run_beside_those_that_hang():
    def hook(x):
        import time

        if x % 5 == 3:
            time.sleep(60)
        return x + 1

    want = [(None, TIME_OUT) if k % 5 == 3 else (k + 1, None) for k in range(60)]
    with Calls(hook, 1.0) as call:
        began = time.monotonic()
        assert call.many(range(60)) == want  # twelve hang for a second each
        assert time.monotonic() - began < 10
        assert call.many(range(3)) == want[:3]  # the processes are still there


def test_batches_of_chunks_are_cut_by_size(monkeypatch):
    monkeypatch.setattr(chunking, "OUTPUT_BYTES", 1000)
    batch = pa.record_batch({"n": range(50), "chunk": [None if k == 7 else "x" * (k * 13 % 400) for k in range(50)]})
    parts = list(chunking._of_size(batch, "chunk"))
    assert pa.Table.from_batches(parts) == pa.Table.from_batches([batch])
    assert len(parts) > 5 and all(sum(len(t or "") for t in p["chunk"].to_pylist()) <= 1400 for p in parts)
    assert list(chunking._of_size(batch.slice(0, 0), "chunk")) == []


def test_line_steps_write_texts_seldom(spark):
    """Texts are shuffled and written as seldom as can be: running values of lines move without them."""
    texts = []

    class Watched(Scratch):
        def spool(self, df, partitions=None):
            texts.extend([c for c in df.columns if c in ("line", "piece", "shown")])
            return super().spool(df, partitions)

    rows = [(d, i, ["# A", "text", "", "# A", "b  c"][i % 5]) for d in range(3) for i in range(20)]
    lines = spark.createDataFrame(rows, "doc_id long, line_no long, line string")
    assert long_documents.repeated_headers(Watched(spark, "test"), lines, 4).count() > 0
    assert texts == []
    assert long_documents.picture_blocks(Watched(spark, "test"), lines, 4).count() == 60
    assert len(texts) <= 3
