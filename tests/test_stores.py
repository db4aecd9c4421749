"""Names Spark hides, relative paths, schemes, odd hook answers, images and failed writes."""

import os

import pytest
from pyspark.sql import functions as F

from foliomark import ConvertOptions
from foliomark.plans.convert import convert, convert_files
from foliomark.sources import files, sinks
from foliomark.sources.listing import listing
from foliomark.sources.stores import Stores, location, qualified
from foliomark.streaming.incremental import convert_new, new_files


@pytest.fixture
def folder(tmp_path):
    for name in ("a.pdf", "_x.pdf", ".y.PDF", "_dir/z.pdf", "sub/_d/e/f.pdf", "sub/.g.pdf", "_n.txt", "in#1/h[1].pdf"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(name.encode())
    return tmp_path


def test_hidden_names_are_scanned(spark, folder):
    flat = {r.path.rsplit("/", 1)[1]: bytes(r.content) for r in files.scan_flat(spark, str(folder)).collect()}
    assert flat == {n: n.encode() for n in ("a.pdf", "_x.pdf", ".y.PDF")}
    tree = {r.rel_path: bytes(r.content) for r in files.scan_tree(spark, str(folder)).collect()}
    assert tree == {n: n.encode() for n in ("a.pdf", "_x.pdf", ".y.PDF", "_dir/z.pdf", "sub/_d/e/f.pdf", "sub/.g.pdf", "in#1/h[1].pdf")}
    assert listing(spark, str(folder / "in#1"), "*.txt", True).count() == 0


@pytest.mark.parametrize("name", ["in", "in/", "a/in", "in#1", "."])
def test_relative_to_any_root(spark, tmp_path, monkeypatch, name):
    monkeypatch.chdir(tmp_path)
    root = tmp_path / name
    (root / "in/sub").mkdir(parents=True, exist_ok=True)
    (root / "in/sub/q.pdf").write_bytes(b"q")
    shown = str(root) + "/" * name.endswith("/")
    found = [r.rel_path for r in files.scan_tree(spark, shown).collect()]
    assert found == ["in/sub/q.pdf"]


def test_relative_path_of_buckets(spark):
    cases = [("s3a://b/sub/a.pdf", "s3a://b", "sub/a.pdf"), ("s3a://in/in/sub/a.pdf", "s3a://in/in", "sub/a.pdf"), ("s3a://in/in/in/a.pdf", "s3a://in/in/", "in/a.pdf")]
    for path, root, expected in cases:
        df = spark.createDataFrame([(path,)], "path string")
        assert df.select(files.relative_path(F.col("path"), root).alias("r")).first().r == expected
    with pytest.raises(Exception, match="not below"):
        spark.createDataFrame([("s3a://c/a.pdf",)], "path string").select(files.relative_path(F.col("path"), "s3a://b")).collect()
    assert qualified(spark, "/data/x/") == "file:/data/x"


def test_schemes():
    assert location("s3a://b/k e/y.md") == "s3://b/k e/y.md" and location("s3n://b/k") == "s3://b/k"
    assert location("file:/tmp/a") == "file:///tmp/a" and location("/tmp/a") == "/tmp/a" and location("hdfs://h:1/a") == "hdfs://h:1/a"


def test_nothing_is_left_of_a_failed_write(tmp_path):
    (tmp_path / "taken.md" / "x").mkdir(parents=True)
    with pytest.raises(OSError):
        Stores().write(f"file:{tmp_path}/taken.md", b"text")
    assert os.listdir(tmp_path) == ["taken.md"]
    Stores().write(f"file:{tmp_path}/new/fine#1.md", b"text")
    assert (tmp_path / "new/fine#1.md").read_bytes() == b"text"


def make_hook():
    def parse(content: bytes) -> list[dict]:
        return {
            b"cells": [{"text": "t", "tables": [[[1, 0, None], ["a", 2.5, ""]]]}],
            b"text": [{"text": 5}],
            b"image": [{"text": "t", "images": ["no bytes"]}],
            b"list": 7,
            b"fine": [{"text": "good", "images": [b"x", None, b"y"]}],
        }[content]

    return parse


def test_one_odd_document_of_each_kind(spark):
    rows = [(k, None if k == "null" else k.encode()) for k in ("fine", "cells", "text", "image", "list", "null", "unknown")]
    got = {r.path: r for r in files.extract(spark.createDataFrame(rows, "path string, content binary"), make_hook()).collect()}
    assert [k for k, r in got.items() if r.error is None] == ["fine", "cells"]
    assert [list(row) for row in got["cells"].pages[0].tables[0]] == [["1", "", ""], ["a", "2.5", ""]]
    assert got["null"].error == "ValueError: no content" and "not str" in got["text"].error and "not bytes" in got["image"].error


def test_images_are_where_the_links_lead(spark, tmp_path):
    docs = spark.createDataFrame([("in/a.pdf", "a", "a.pdf", f"{tmp_path}/out/a.md", b"fine")], "path string, stem string, name string, out_path string, content binary")
    read = files.extract(docs, make_hook())
    text = convert(read, ConvertOptions(extract_images=True)).first().text
    listing = {r.out_path: r.status for r in sinks.export_images(read, str(tmp_path / "manifest")).collect()}
    links = [part.split(")")[0] for part in text.split("](")[1:]]
    assert len(links) == 2 and [(tmp_path / "out" / link).read_bytes() for link in links] == [b"x", b"y"]
    assert sorted(listing.values()) == ["failed", "written", "written"]


def test_upper_case_suffix_wins(spark):
    docs = spark.createDataFrame([("/x/a.pdf", "/o/a.md"), ("/x/a.PDF", "/o/a.md"), ("/x/B.PDF", "/o/b.md")], "path string, out_path string")
    assert sinks.path_collisions(docs).first().kept == "/x/a.PDF"
    assert {r.path: r.superseded for r in sinks.mark_superseded(docs).collect()} == {"/x/a.pdf": True, "/x/a.PDF": False, "/x/B.PDF": False}


def test_parser_runs_once_for_each_file(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    (tmp_path / "in").mkdir()
    for name in ("a", "b"):
        (tmp_path / f"in/{name}.pdf").write_bytes(name.encode())

    def parse(content: bytes) -> list[dict]:
        import uuid
        from pathlib import Path

        (Path(str(calls)) / f"{content.decode()}-{uuid.uuid4().hex}").touch()
        return [{"text": content.decode() + "\n\nmore"}]

    placed = files.with_identity(files.scan_flat(spark, str(tmp_path / "in")), str(tmp_path / "out")).withColumn("doc_id", F.lit(5))
    done = convert_files(placed, parse, ConvertOptions(cleanup=True, transform=str.upper, chunk_limit=4))
    assert done.count() == 2 and len(os.listdir(calls)) == 2


def test_stream_takes_files_of_any_age(spark, tmp_path):
    source, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    (source / "sub").mkdir(parents=True)

    def run():
        stream = new_files(spark, str(source), files.FILES, pattern="*.pdf", recursive=True)
        convert_new(stream, lambda d: d.select("path"), out, state).awaitTermination()
        return {r.path.rsplit("/", 1)[1] for r in spark.read.schema("path string").parquet(out).collect()}

    (source / "new.pdf").write_bytes(b"1")
    assert run() == {"new.pdf"}
    (source / "sub/old.pdf").write_bytes(b"2")
    os.utime(source / "sub/old.pdf", (1, 1))
    assert run() == {"new.pdf", "old.pdf"}


def test_moves_into_names_that_are_taken(tmp_path):
    stores = Stores()
    stores.put(f"file:{tmp_path}/a", b"long content")
    stores.put(f"file:{tmp_path}/a", b"short")
    stores.put(f"file:{tmp_path}/b", b"other")
    stores.move(f"file:{tmp_path}/a", f"file:{tmp_path}/new/b")
    stores.move(f"file:{tmp_path}/b", f"file:{tmp_path}/new/b")
    assert stores.read(f"file:{tmp_path}/new/b") == b"other" and os.listdir(tmp_path) == ["new"]
    stores.move_once(f"file:{tmp_path}/b", f"file:{tmp_path}/new/b")  # made before
    with pytest.raises(FileNotFoundError):
        stores.move_once(f"file:{tmp_path}/b", f"file:{tmp_path}/new/c")
    assert not stores.shift(f"file:{tmp_path}/none", f"file:{tmp_path}/x")
