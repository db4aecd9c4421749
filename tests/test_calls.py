"""Deadlines of external calls, and cascades of modes with the calls they make."""

import os
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from foliomark import ConvertOptions
from foliomark.operators import chunking
from foliomark.operators.calls import TIME_OUT, Calls
from foliomark.operators.chunking import Mode, cascade
from foliomark.plans.convert import convert_files
from foliomark.sources import files


def hook_of(log=None, name=""):
    """A hook that does what its text says; it notes its calls in a folder."""

    def hook(text):
        import os
        import subprocess
        import time
        import uuid

        if log:
            open(os.path.join(log, f"{name}-{uuid.uuid4().hex}"), "w").close()
        if "hang" in text:
            child = subprocess.Popen(["sleep", "600"])
            if log:
                open(os.path.join(log, f"child-{child.pid}"), "w").close()
            time.sleep(600)
        if "crash" in text:
            os._exit(3)
        if "fail" in text:
            raise ValueError("no")
        if "blank" in text:
            return " \n"
        if "odd" in text:
            return 5
        print("noise on stdout")
        return text.upper()

    return hook


def test_a_call_over_its_time_is_ended(tmp_path):
    with Calls(hook_of(str(tmp_path), "call"), 1.0) as call:
        assert call("a") == ("A", None)
        begin = time.monotonic()
        assert call("hang") == (None, TIME_OUT)
        assert time.monotonic() - begin < 10
        assert call("b") == ("B", None)
        answer, error = call("crash")
        assert answer is None and "ended with 3" in error
        assert call("fail") == (None, "ValueError: no")
        assert call("x" * 3_000_000) == ("X" * 3_000_000, None)
    children = [int(p.name.split("-")[1]) for p in tmp_path.glob("child-*")]
    assert len(children) == 1 and not _alive(children[0])


def _alive(pid):
    try:
        with open(f"/proc/{pid}/stat") as stat:
            return stat.read().split(")")[1].split()[0] != "Z"
    except FileNotFoundError:
        return False


def test_without_a_deadline_the_task_itself_calls():
    with Calls(lambda x: (os.getpid(), x)) as call:
        assert call(1) == ((os.getpid(), 1), None)
    with pytest.raises(ValueError, match="needs time"):
        Calls(str, 0)


def test_hanging_chunks_are_rows(spark):
    texts = [(k, f"{'hang' if k % 10 == 3 else 'odd' if k == 5 else 'crash' if k == 7 else 'word'} {k}") for k in range(24)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    done = chunking.map_chunks(chunking.chunk_documents(docs), hook_of(), 2, seconds=1.0)
    rows = {r.doc_id: (r.result, r.error) for r in done.collect()}
    for k, text in texts:
        result, error = rows[k]
        if "word" in text:
            assert (result, error) == (text.upper(), None)
        else:
            assert result is None
            assert error == {"h": TIME_OUT, "o": "TypeError: the transform gave int, not str"}.get(text[0], error)
    whole = chunking.transform_documents(docs, hook_of(), seconds=1.0)
    assert {r.doc_id: (r.text, r.transformed) for r in whole.collect()} == {k: (t.upper(), True) if "word" in t else (t, False) for k, t in texts}


def test_a_parser_over_its_time_fails_its_file_alone(spark):
    def parse(content):
        if content == b"hang":
            time.sleep(600)
        return [{"text": content.decode()}]

    raw = spark.createDataFrame([(f"/in/{k}.pdf", b"hang" if k == 2 else b"text") for k in range(6)], "path string, content binary").coalesce(1)
    rows = {r.path: (r.error, r.pages and r.pages[0].text) for r in files.extract(raw, parse, 1.0).collect()}
    assert rows.pop("/in/2.pdf") == (TIME_OUT, None)
    assert set(rows.values()) == {(None, "text")} and len(rows) == 5


WORDS = ["fine", "hang", "fail", "blank", "crash"]


def test_each_mode_sees_what_is_left(spark, tmp_path):
    log = str(tmp_path)
    texts = [(k, f"one {WORDS[k % 5]}\n\ntwo {k}") for k in range(20)] + [(20, None), (21, " "), (None, "no number")]
    docs = spark.createDataFrame([(k, t, "kept", "old") for k, t in texts], "doc_id long, text string, source string, mode string")

    note = hook_of(log, "second")

    def second(text):
        note("word")
        if "fail" in text:
            raise ValueError("still")
        return "  2:" + text + "\n"

    modes = [
        Mode("first", hook_of(log, "first"), limit=8, seconds=1.0),
        Mode("second", second, limit=None, seconds=None),
        Mode("third", hook_of(log, "third"), limit=None, seconds=1.0),
    ]
    done = cascade(docs, modes)
    rows = {r.doc_id: (r.text, r.mode, r.source) for r in done.docs.collect()}
    tried = {(r.doc_id, r.mode): (r.n_calls, r.n_failed, r.n_blank, r.error) for r in done.attempts.collect()}
    for k, text in texts[:20]:
        word = WORDS[k % 5]
        want = (text.upper(), "first") if word == "fine" else (text, None) if word == "fail" else ("2:" + text, "second")
        assert rows[k] == (*want, "kept")
        assert tried[k, "first"][:3] == (2, int(word in ("hang", "fail", "crash")), int(word == "blank"))
        assert ((k, "second") in tried) == (word != "fine") and ((k, "third") in tried) == (word == "fail")
    assert rows[20] == (None, None, "kept") and rows[21] == (" ", None, "kept") and rows[None] == ("no number", None, "kept")
    calls = Counter(p.name.split("-")[0] for p in tmp_path.glob("*"))
    assert calls["first"] == 40 and calls["second"] == 16 and calls["third"] == 4
    assert tried[1, "first"][3] == TIME_OUT and "ended with 3" in tried[4, "first"][3]
    done.docs.count()  # asked again, no call is repeated
    assert Counter(p.name.split("-")[0] for p in tmp_path.glob("*")) == calls
    root = done.scratch.root.removeprefix("file:")
    assert os.path.exists(root)
    done.scratch.release()
    assert not os.path.exists(root)


def test_modes_after_the_last_document_are_not_called(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    log = str(tmp_path)
    done = cascade(docs, [Mode("one", hook_of(log, "one")), Mode("two", hook_of(log, "two"))])
    assert {r.mode for r in done.docs.collect()} == {"one"}
    assert Counter(p.name.split("-")[0] for p in tmp_path.glob("*")) == {"one": 2}
    none = cascade(docs, [])
    assert {(r.text, r.mode) for r in none.docs.collect()} == {("a", None), ("b", None)} and none.attempts.count() == 0
    empty = cascade(docs.limit(0), [Mode("one", hook_of())])
    assert empty.docs.count() == 0 and empty.attempts.count() == 0
    with pytest.raises(ValueError, match="names of their own"):
        cascade(docs, [Mode("x", str), Mode("x", str)])


def test_conversion_with_modes(spark):
    raw = spark.createDataFrame([(f"/in/{w}.pdf", w.encode()) for w in ("fine", "fail")], "path string, content binary")
    placed = files.with_identity(raw, "/out")
    shout = Mode("shout", hook_of(), seconds=2.0)
    wrap = Mode("wrap", lambda t: f"<{t.strip()}>", limit=None)
    options = ConvertOptions(cleanup=True, modes=(shout, wrap), page_breaks=False)
    rows = {r.path: r.text for r in convert_files(placed, lambda c: [{"text": c.decode()}], options).collect()}
    assert "FINE" in rows["/in/fine.pdf"] and rows["/in/fail.pdf"].startswith("<") and "fail" in rows["/in/fail.pdf"]


def test_attempts_count_calls(spark):
    docs = spark.range(30).select(F.col("id").alias("doc_id"), F.lit("a\n\nb\n\nc").alias("text"))
    done = cascade(docs, [Mode("fails", lambda t: 1 / 0, limit=2), Mode("works", str.upper, limit=None)])
    sums = done.attempts.groupBy("mode").agg(F.sum("n_calls").alias("calls"), F.sum("n_failed").alias("failed")).collect()
    assert {(r.mode, r.calls, r.failed) for r in sums} == {("fails", 90, 90), ("works", 30, 0)}
