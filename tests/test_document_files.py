"""Export with a commit: texts and images of one parse, nothing left of a failed write, moves that can be repeated."""

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from foliomark import ConvertOptions
from foliomark.plans.convert import convert_files
from foliomark.sources import document_files, files
from foliomark.sources.document_files import DocumentWriter, committed, export_documents, publish

IMAGE = "struct<out_path:string,page_no:int,img_no:int,content:binary>"


def left(folder):
    return sorted(str(p.relative_to(folder)) for p in Path(folder).rglob("*") if p.is_file() and not p.name.endswith(".crc"))


def docs_of(spark, tmp_path, rows):
    schema = f"path string, out_path string, text string, error string, images array<{IMAGE}>"
    out = tmp_path / "out"
    return spark.createDataFrame([(p, f"{out}/{o}", t, e, [(f"{out}/{n}", 1, k, c) for k, (n, c) in enumerate(i, 1)]) for p, o, t, e, i in rows], schema)


def test_texts_and_images_of_one_parse(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    for name in ("a", "b", "bad"):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / f"in/{name}.pdf").write_bytes(name.encode())

    def parse(content):
        import uuid
        from pathlib import Path

        (Path(str(calls)) / f"{content.decode()}-{uuid.uuid4().hex}").touch()
        if content == b"bad":
            raise ValueError("cannot")
        return [{"text": f"page {k} of {content.decode()}", "images": [content, None, b""]} for k in (1, 2)]

    placed = files.with_identity(files.scan_flat(spark, str(tmp_path / "in")), str(tmp_path / "out"))
    done = convert_files(placed, parse, ConvertOptions(extract_images=True))
    rows = export_documents(done, str(tmp_path / "manifest")).collect()
    assert len(os.listdir(calls)) == 3
    names = [f"images/{d}/page_{p}_img_{i}.png" for d in "ab" for p in (1, 2) for i in (1, 3)]
    assert left(tmp_path / "out") == sorted(["a.md", "b.md", *names])
    text = (tmp_path / "out/a.md").read_text()
    links = [part.split(")")[0] for part in text.split("](")[1:]]
    assert [(tmp_path / "out" / n).read_bytes() for n in links] == [b"a", b"", b"a", b""]
    status = {(r.kind, r.path.rsplit("/", 1)[1]): (r.status, r.error) for r in rows}
    assert status["text", "bad.pdf"] == ("failed", "ValueError: cannot") and status["image", "a.pdf#2.2"] == ("failed", "no content")
    assert len(rows) == 3 + 12 and sum(r.status == "written" for r in rows) == 10
    assert not (tmp_path / "manifest.staging").exists()


def test_collisions_take_their_images_along(spark, tmp_path):
    rows = [
        ("/in/x.pdf", "x.md", "low", None, [("i/1.png", b"low")]),
        ("/in/x.PDF", "x.md", "high", None, [("i/1.png", b"high")]),
        ("/in/z.PDF", "x.md", None, "broken", [("i/1.png", b"z")]),
        ("/in/n.pdf", "n.md", None, None, []),
    ]
    found = export_documents(docs_of(spark, tmp_path, rows), str(tmp_path / "m")).collect()
    assert (tmp_path / "out/x.md").read_text() == "high" and (tmp_path / "out/i/1.png").read_bytes() == b"high"
    assert sorted((r.kind, r.path, r.status) for r in found) == [
        ("image", "/in/x.PDF#1.1", "written"), ("image", "/in/x.pdf#1.1", "superseded"), ("text", "/in/n.pdf", "failed"),
        ("text", "/in/x.PDF", "written"), ("text", "/in/x.pdf", "superseded"), ("text", "/in/z.PDF", "failed"),
    ]


def test_nothing_is_left_of_a_write_that_fails(spark, tmp_path):
    rows = [(f"/in/{k}.pdf", f"{k}.md", str(k), None, [(f"{k}.png", b"i")]) for k in range(40)]
    bad = F.when(F.col("path") == "/in/33.pdf", F.raise_error(F.lit("lost")).cast("string")).otherwise(F.col("text"))
    docs = docs_of(spark, tmp_path, rows).repartition(4).withColumn("text", bad)
    with pytest.raises(Exception, match="lost"):
        export_documents(docs, str(tmp_path / "m"))
    assert left(tmp_path) == [] and not committed(spark, str(tmp_path / "m"))
    with pytest.raises(RuntimeError, match="nothing is committed"):
        publish(spark, str(tmp_path / "m"))


def test_a_committed_write_is_finished_later(spark, tmp_path, monkeypatch):
    rows = [(f"/in/{k}.pdf", f"{k}.md", str(k), None, [(f"{k}.png", b"i")]) for k in range(10)]
    target = str(tmp_path / "m")

    def dies(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(document_files, "publish", dies)
    with pytest.raises(KeyboardInterrupt):
        export_documents(docs_of(spark, tmp_path, rows), target)
    assert committed(spark, target) and not (tmp_path / "out").exists()
    # a publish that had moved some files already, and a lost attempt nobody named
    import pyarrow.parquet as pq

    listed = [r for p in Path(f"{target}.staging").rglob("staged.parquet") for r in pq.ParquetFile(p).read().to_pylist()]
    (tmp_path / "out").mkdir()
    os.rename(listed[0]["staged"].removeprefix("file:"), listed[0]["out_path"])
    lost = tmp_path / "m.staging" / "lost"
    lost.mkdir()
    (lost / "0").write_bytes(b"twice")
    found = publish(spark, target).collect()
    assert {r.status for r in found} == {"written"} and len(found) == 20
    assert left(tmp_path / "out") == sorted([f"{k}.{s}" for k in range(10) for s in ("md", "png")])
    assert (tmp_path / "out/3.md").read_text() == "3" and not (tmp_path / "m.staging").exists()
    assert publish(spark, target).count() == 20  # done already


def test_a_file_that_cannot_be_moved_is_a_row(spark, tmp_path):
    (tmp_path / "out/a.md/x").mkdir(parents=True)
    rows = [("/in/a.pdf", "a.md", "a", None, []), ("/in/b.pdf", "b.md", "b", None, [])]
    found = {r.path: r.status for r in export_documents(docs_of(spark, tmp_path, rows), str(tmp_path / "m")).collect()}
    assert found == {"/in/a.pdf": "failed", "/in/b.pdf": "written"}


def test_no_documents(spark, tmp_path):
    assert export_documents(docs_of(spark, tmp_path, []), str(tmp_path / "m")).count() == 0


def test_a_task_removes_what_it_staged(tmp_path):
    def batches():
        import pyarrow as pa

        yield pa.RecordBatch.from_pylist([{"path": "p", "out_path": "o", "text": "t", "error": None, "images": []}])
        raise OSError("gone")

    (tmp_path / "s").mkdir()
    with pytest.raises(OSError, match="gone"):
        DocumentWriter(str(tmp_path / "s")).write(batches())
    assert left(tmp_path) == []
    with pytest.raises(OSError):  # after an abort
        DocumentWriter(str(tmp_path / "none")).write(batches())
    assert not (tmp_path / "none").exists()


def test_an_export_writes_into_the_files_of_the_one_before(spark, tmp_path):
    """Files of a withdrawn export are used again whole: no part of what they held is left, and none has two names."""
    target, out = str(tmp_path / "m"), tmp_path / "out"
    inodes = []
    with document_files.staging_kept(spark, target):
        for turn, size in enumerate((50, 3, 20)):
            rows = [(f"/in/{turn}-{k}.pdf", f"{turn}-{k}.md", f"t{k}" * (k % size), None, [(f"i/{turn}-{k}/{j}.png", b"x" * (j * size)) for j in range(3)]) for k in range(30)]
            rows.append((f"/in/{turn}.pdf", "", None, "broken", []))
            found = export_documents(docs_of(spark, tmp_path, rows).repartition(3), target)
            assert found.count() == 30 * 4 + 1 and left(out) == sorted([n for r in rows[:30] for n in (r[1], *(i for i, _ in r[4]))])
            for _, name, text, _, images in rows[:30]:
                assert (out / name).read_text() == text and [(out / n).read_bytes() for n, _ in images] == [c for _, c in images]
            inodes.append({(out / n).stat().st_ino for n in left(out)})
            assert len(inodes[-1]) == 30 * 4 and all((out / n).stat().st_nlink == 1 for n in left(out))
            document_files.withdraw(spark, found, target)
            assert left(out) == [] and not list((out / "i").iterdir())
    assert len(inodes[0] & inodes[1]) > 90 and len(inodes[1] & inodes[2]) > 90
    assert left(tmp_path) == [n for n in left(tmp_path) if n.startswith("m/")]
