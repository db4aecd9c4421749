"""Scans, identity, extraction, export, whole conversions and the stream, over real files."""

import pytest
import spec
from pyspark.sql import functions as F

from foliomark import ConvertOptions, convert_directory
from foliomark.functions import lines, tables
from foliomark.operators import chunking, documents, pages
from foliomark.plans.convert import convert, convert_files
from foliomark.sources import files, sinks
from foliomark.streaming.incremental import convert_new, new_files


def make_parser():
    # Local, so that it is sent to the workers instead of imported by them.
    def parse(content: bytes) -> list[dict]:
        if content == b"broken":
            raise ValueError("cannot parse")
        return [
            {"text": text, "tables": [[["a", None], ["1", "2"]]], "images": [b"x", None, b"y"]}
            for text in content.decode("utf-8").split("\f")
        ]

    return parse


by_form_feed = make_parser()


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "in"
    (root / "sub" / "deep").mkdir(parents=True)
    for name, content in {
        "a.pdf": "HEAD ONE\ntext\n\f- two\nmore", "b.PDF": "# one", "c.Pdf": "no", "d.txt": "no",
        "bad.pdf": "broken", "sub/a.pdf": "sub a", "sub/deep/e.v2.PDF": "deep e", "x.pdf.PDF": "twice",
    }.items():
        (root / name).write_bytes(content.encode())
    return root


def names(df):
    return sorted(r.name for r in df.select(files.file_name(F.col("path")).alias("name")).collect())


def test_scan_flat(spark, folder):
    assert names(files.scan_flat(spark, str(folder))) == ["a.pdf", "b.PDF", "bad.pdf", "x.pdf.PDF"]


def test_scan_tree(spark, folder):
    found = files.scan_tree(spark, str(folder))
    assert {r.rel_path for r in found.select("rel_path").collect()} == {
        "a.pdf", "b.PDF", "bad.pdf", "x.pdf.PDF", "sub/a.pdf", "sub/deep/e.v2.PDF",
    }
    placed = files.with_identity(found, "/out", mirror=True).select("rel_path", "out_path", "stem")
    assert {r.rel_path: (r.out_path, r.stem) for r in placed.collect()} == {
        "a.pdf": ("/out/a.md", "a"), "b.PDF": ("/out/b.md", "b"), "bad.pdf": ("/out/bad.md", "bad"),
        "x.pdf.PDF": ("/out/x.pdf.md", "x.pdf"), "sub/a.pdf": ("/out/sub/a.md", "a"),
        "sub/deep/e.v2.PDF": ("/out/sub/deep/e.v2.md", "e.v2"),
    }


def test_empty_folder(spark, tmp_path):
    (tmp_path / "note.txt").write_text("no")
    found = files.scan_flat(spark, str(tmp_path))
    assert found.count() == 0 and files.corpus_listing(found).count() == 0


def test_validate(spark):
    paths = spark.createDataFrame([("/x/a.pdf",), ("/x/b.PdF",), ("/x/c.txt",), ("/x/.pdf",), ("/x/pdf",)], ["path"])
    verdict = {r.path: (r.accepted, r.reason) for r in files.validate_inputs(paths).collect()}
    assert [p for p, (ok, _) in verdict.items() if ok] == ["/x/a.pdf", "/x/b.PdF"]
    assert verdict["/x/c.txt"][1] == "not a PDF: /x/c.txt"


def test_stem_like_pathlib(spark):
    from pathlib import PurePosixPath

    cases = ["a.pdf", "a.b.pdf", ".pdf", "a", "a.", ".a.b", "ä ö.PDF"]
    df = spark.createDataFrame([(c,) for c in cases], ["n"])
    got = {r.n: r.s for r in df.select("n", files.file_stem(F.col("n")).alias("s")).collect()}
    assert got == {c: PurePosixPath(c).stem for c in cases}


def test_extract_numbers_and_errors(spark, folder):
    rows = {r.path.rsplit("/", 1)[1]: r for r in files.extract(files.scan_flat(spark, str(folder)), by_form_feed).collect()}
    assert [p.page_no for p in rows["a.pdf"].pages] == [1, 2]
    assert [i.img_no for i in rows["a.pdf"].pages[0].images] == [1, 2, 3]
    assert rows["bad.pdf"].pages is None and rows["bad.pdf"].error == "ValueError: cannot parse"


def test_convert_directory(spark, folder):
    done = convert_directory(spark, str(folder), by_form_feed, "/out", options=ConvertOptions(extract_images=True))
    rows = {r.out_path: r for r in done.collect()}
    table = "\n| a |  |\n|---|---|\n| 1 | 2 |\n"

    def images(page):
        return [f"\n![page_{page}_img_{i}.png](images/a/page_{page}_img_{i}.png)\n" for i in (1, 3)]

    items = [
        spec.format_text("HEAD ONE\ntext\n"), *images(1), table,
        "\n---\n", "*Page 2*\n\n", spec.format_text("- two\nmore"), *images(2), table,
    ]
    expected = spec.cleanup("# a\n\n*Converted from: a.pdf*\n\n---\n\n" + "\n".join(items))
    assert rows["/out/a.md"].text == expected
    assert rows["/out/bad.md"].text is None and "cannot parse" in rows["/out/bad.md"].error


def test_export_and_manifest(spark, folder, tmp_path):
    out = tmp_path / "out"
    # Flat output: two inputs named a.pdf claim one file, the greater path keeps it.
    placed = files.with_identity(files.scan_tree(spark, str(folder)), str(out))
    done = convert_files(placed, by_form_feed, ConvertOptions(tables=False))
    listing = sinks.export_markdown(done, str(tmp_path / "manifest")).collect()
    status = {r.path.split("/in/")[1]: r.status for r in listing}
    assert status == {
        "a.pdf": "superseded", "sub/a.pdf": "written", "b.PDF": "written", "bad.pdf": "failed",
        "x.pdf.PDF": "written", "sub/deep/e.v2.PDF": "written",
    }
    assert sorted(p.name for p in out.iterdir()) == ["a.md", "b.md", "e.v2.md", "x.pdf.md"]
    assert (out / "a.md").read_text("utf-8") == "# a\n\n*Converted from: a.pdf*\n\n---\n\nsub a\n"
    counts = {r.status: r.n for r in sinks.manifest_counts(spark.read.parquet(str(tmp_path / "manifest"))).collect()}
    assert counts == {"written": 4, "failed": 1, "superseded": 1}


def test_export_write_failure_is_a_row(spark, tmp_path):
    (tmp_path / "file").write_text("in the way")
    docs = spark.createDataFrame([("p", str(tmp_path / "file" / "x.md"), "t")], ["path", "out_path", "text"])
    row = sinks.export_markdown(docs, str(tmp_path / "m")).first()
    assert row.status == "failed" and row.error


def test_stream_converts_only_new_files(spark, folder, tmp_path):
    out, state = str(tmp_path / "table"), str(tmp_path / "state")

    def run():
        stream = new_files(spark, str(folder), files.FILES, pattern=files.PATTERN)
        step = lambda f: convert_files(files.with_identity(f, "/out"), by_form_feed)
        convert_new(stream, step, out, state).awaitTermination()
        return {r.out_path: r.text for r in spark.read.parquet(out).collect()}

    first = run()
    (folder / "late.pdf").write_bytes(b"late text")
    second = run()
    assert set(second) - set(first) == {"/out/late.md"}
    assert spark.read.parquet(out).count() == len(second)


def test_transform_hook(spark):
    docs = spark.createDataFrame(
        [(1, "aa\n\nbb\n\ncc"), (2, "fail\n\nbb"), (3, "blank\n\nbb"), (4, "short")], "doc_id long, text string"
    )

    def shout(chunk):
        if chunk == "fail":
            raise RuntimeError("down")
        return " \n" if chunk == "blank" else f" {chunk.upper()} "

    done = {r.doc_id: (r.text, r.transformed) for r in chunking.transform_documents(docs, shout, 4).collect()}
    assert done == {
        1: ("AA \n\n BB \n\n CC", True), 2: ("fail\n\nbb", False), 3: ("blank\n\nbb", False), 4: ("SHORT", True),
    }
    spread = chunking.map_chunks(chunking.chunk_documents(docs, 4), shout, tasks=5)
    assert spread.rdd.getNumPartitions() == 5
    assert spread.count() == chunking.chunk_documents(docs, 4).count()
    same = chunking.transform_documents(docs, None).collect()
    assert [r.text for r in same] == [r.text for r in docs.collect()]


def test_missing_chunk_keeps_original(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    results = spark.createDataFrame([(1, 0, 2, "A", None)], "doc_id long, chunk_no int, n_chunks int, result string, error string")
    assert chunking.fallback_to_original(docs, results).first().text == "a b"


def test_cleanup_asked_without_transform_warns(spark):
    docs = spark.createDataFrame([("p", "n", "s", [(1, "x")])], "path string, name string, stem string, pages array<struct<page_no:int,text:string>>")
    with pytest.warns(UserWarning):
        out = convert(docs, ConvertOptions(tables=False, cleanup=True))
    assert out.first().text.endswith("x\n")


def test_embedded_images_and_options(spark):
    schema = "path string, name string, stem string, pages array<struct<page_no:int,text:string,images:array<struct<img_no:int,content:binary>>>>"
    docs = spark.createDataFrame([("p", "s.pdf", "s", [(1, "T  x", [(1, b"a" * 90)]), (2, None, [])])], schema)
    o = ConvertOptions(tables=False, extract_images=True, embed_images=True, page_breaks=False,
                       page_separators=True, preserve_formatting=False)
    text = convert(docs, o).first().text
    assert "![page_1_img_1.png](data:image/png;base64," + "YWFh" * 30 + ")" in text
    assert text.count("-----") == 2 and "*Page" not in text and "T  x" in text


def test_pages_without_text_or_pages(spark):
    docs = spark.createDataFrame([("p", "s.pdf", "s", [])], "path string, name string, stem string, pages array<struct<page_no:int,text:string>>")
    assert convert(docs, ConvertOptions(tables=False)).first().text == "# s\n\n*Converted from: s.pdf*\n\n---\n"


@pytest.mark.parametrize(
    "rows, expected",
    [([], ""), ([[]], ""), ([["a", None], ["b"], []], "| a |  |\n|---|---|\n| b |\n|  |"), ([["x|y"]], "| x|y |\n|---|")],
)
def test_render_table(spark, rows, expected):
    df = spark.createDataFrame([(rows,)], "rows array<array<string>>")
    assert df.select(tables.render_table(F.col("rows"))).first()[0] == expected == spec.table(rows)


def test_line_kinds(spark):
    cases = ["- ABC", "IT'S", "---", "•", "A" * 59, "A" * 60, "1. x", "1.x", "x", "", " \x1c "]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, line string")
    got = [(r.kind, r.md) for r in documents.classify_lines(df).orderBy("i").collect()]
    assert got == [(spec.kind(c.strip()), spec.markdown(c.strip())) for c in cases]
    assert got[0] == ("heading", "## - Abc") and got[2] == ("bullet", "- --") and got[3] == ("bullet", "- ")
    assert lines.HEADING_LIMIT == 60


def test_strip_edges(spark):
    texts = ["Top\nbody 1\nPage 1", "\nTOP\n\nbody 2\nPage 2\n", "Only", "# Top\nPage 3", "", "Top"]
    docs = spark.createDataFrame([(1, [(i + 1, t) for i, t in enumerate(texts)])], "doc_id long, pages array<struct<page_no:int,text:string>>")
    expected = ["body 1", "\n\nbody 2\n", "Only", "", "", ""]
    arrays = pages.enumerate_pages(pages.strip_headers_footers(docs)).orderBy("page_no")
    rows = pages.strip_page_table(pages.enumerate_pages(docs), span=2).orderBy("page_no")
    assert [r.text for r in arrays.collect()] == expected
    assert [r.text for r in rows.collect()] == expected
