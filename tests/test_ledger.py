"""Listings made by tasks, and a folder that changes between runs."""

import os
import re

import pytest
from pyspark.errors import AnalysisException

from foliomark.sources import files
from foliomark.sources.ledger import Ledger
from foliomark.sources.listing import contents, listing, name_pattern
from foliomark.streaming.incremental import convert_changes, current_corpus


def write(path, text="x"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode())


@pytest.mark.parametrize(("glob", "yes", "no"), [
    ("*.{pdf,PDF}", ["a.pdf", ".PDF", "_x.pdf"], ["a.Pdf", "a.pdfx", "pdf"]),
    ("d?[0-9].md", ["dx1.md"], ["d1.md", "dxa.md"]),
    ("[!a-c]*", ["d", "_"], ["a", "cat"]),
    ("a\\*b", ["a*b"], ["axb"]),
    ("a,b", ["a,b"], ["a"]),
    ("[x", ["[x"], ["x"]),
])
def test_globs(glob, yes, no):
    fits = re.compile(name_pattern(glob), re.DOTALL)
    assert all(fits.fullmatch(n) for n in yes) and not any(fits.fullmatch(n) for n in no)
    with pytest.raises(ValueError, match="brace"):
        name_pattern("*.{a")


@pytest.mark.parametrize("budget", [1, 3, 10_000])
def test_every_file_is_listed_once(spark, tmp_path, budget):
    want = {}
    for k in range(40):
        rel = "/".join(["_h" if k % 3 else "v"] * (k % 7) + [f"{'.' if k % 5 == 0 else ''}f{k}.pdf"])
        write(tmp_path / rel, "x" * k)
        want[rel] = k
    write(tmp_path / "v/other.txt")
    (tmp_path / "empty/deep").mkdir(parents=True)
    os.symlink(tmp_path, tmp_path / "v/loop")
    found = listing(spark, str(tmp_path), "*.pdf", recursive=True, budget=budget).collect()
    root = f"file:{tmp_path}/"
    assert {r.path.removeprefix(root): r.length for r in found} == want and len(found) == len(want)
    assert all(abs(r.modificationTime.timestamp() - os.stat(r.path.removeprefix("file:")).st_mtime) < 1e-3 for r in found)


def test_empty_and_missing_folders(spark, tmp_path):
    assert listing(spark, str(tmp_path)).count() == 0
    assert files.scan_flat(spark, str(tmp_path)).count() == 0
    with pytest.raises(AnalysisException, match="does not exist"):
        files.scan_flat(spark, str(tmp_path / "none"))


def test_a_file_that_disappears_has_no_content(spark, tmp_path):
    for k in range(3):
        write(tmp_path / f"{k}.pdf", "x")
    listed = listing(spark, str(tmp_path), "*.pdf")
    os.remove(tmp_path / "1.pdf")
    assert {r.path[-5:]: r.content for r in contents(listed).collect()} == {"0.pdf": b"x", "1.pdf": None, "2.pdf": b"x"}


def step_of(bad=b"bad"):
    def step(raw):
        from pyspark.sql import functions as F

        kept = raw.where("rel_path NOT LIKE '%skip%'")
        return kept.select("path", "rel_path", F.col("content").cast("string").alias("text"), F.when(F.col("content") == F.lit(bad), "broken").alias("error"))

    return step


@pytest.fixture
def place(spark, tmp_path):
    class Place:
        root, out, book = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ledger")

        def run(self, step=None, **options):
            rows = convert_changes(spark, str(self.root), step or step_of(), self.out, self.book, recursive=True, **options).collect()
            assert len({r.path for r in rows}) == len(rows)
            return {r.path.removeprefix(f"file:{self.root}/"): (r.fate, r.outcome, r.error) for r in rows}

        def corpus(self):
            return {r.rel_path: (r.text, r.error) for r in current_corpus(spark, self.out, self.book).collect()}

    (tmp_path / "in").mkdir()
    return Place()


def test_fates(place):
    assert place.run() == {}
    for name, text in {"a.pdf": "one", "_h/.b.PDF": "two", "c.pdf": "bad", "skip.pdf": "no", "d.pdf": "four"}.items():
        write(place.root / name, text)
    first = place.run()
    assert first == {
        "a.pdf": ("new", "converted", None), "_h/.b.PDF": ("new", "converted", None), "c.pdf": ("new", "failed", "broken"),
        "skip.pdf": ("new", "rejected", None), "d.pdf": ("new", "converted", None),
    }
    write(place.root / "a.pdf", "other")
    os.utime(place.root / "d.pdf", (5, 5))  # the same bytes with another time
    os.remove(place.root / "_h/.b.PDF")
    write(place.root / "sub/e.pdf", "five")
    assert place.run() == {
        "a.pdf": ("rewritten", "converted", None), "_h/.b.PDF": ("deleted", "converted", None), "c.pdf": ("unchanged", "failed", "broken"),
        "skip.pdf": ("unchanged", "rejected", None), "d.pdf": ("rewritten", "converted", None), "sub/e.pdf": ("new", "converted", None),
    }
    assert place.corpus() == {"a.pdf": ("other", None), "c.pdf": ("bad", "broken"), "d.pdf": ("four", None), "sub/e.pdf": ("five", None)}
    write(place.root / "_h/.b.PDF", "two")
    third = place.run(step_of(b"none"), retry=True)
    assert third["_h/.b.PDF"] == ("new", "converted", None) and third["c.pdf"] == ("retried", "converted", None)
    assert {n: f[0] for n, f in third.items() if f[0] != "unchanged"} == {"_h/.b.PDF": "new", "c.pdf": "retried"}
    assert place.corpus()["c.pdf"] == ("bad", None)


def test_a_run_that_dies_is_repeated(spark, place):
    write(place.root / "a.pdf", "one")

    def dies(raw):
        from pyspark.sql import functions as F

        return raw.select("path", F.raise_error(F.lit("lost")).cast("string").alias("error"))

    with pytest.raises(Exception, match="lost"):
        place.run(dies)
    book = Ledger(spark, place.book)
    assert book.versions() == [] and book.run() == 1
    assert place.run() == {"a.pdf": ("new", "converted", None)} and place.corpus() == {"a.pdf": ("one", None)}
    # an incomplete version does not count
    os.makedirs(f"{place.book}/v=2")
    assert book.versions() == [1] and place.run() == {"a.pdf": ("unchanged", "converted", None)}
    for k in range(3):
        write(place.root / f"{k}.pdf")
        place.run()
    assert len(book.versions()) == 2
