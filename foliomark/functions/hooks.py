"""Hooks as table functions, for use in SQL text with LATERAL.

``register_parser`` and ``register_transform`` give a hook a name in the session:

    SELECT d.path, p.page_no, p.text FROM files d, LATERAL parse_pages(d.content) p
    SELECT c.doc_id, t.result FROM chunks c, LATERAL call_transform(c.chunk) t

A failure is a row with its ``error``, never a lost query; with ``seconds`` a call has a deadline.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from foliomark.operators.calls import Calls

PAGE = "page_no int, text string, tables array<array<array<string>>>, images array<binary>, error string"
ANSWER = "result string, error string"


def register_parser(spark: SparkSession, name: str, extractor: Callable[[bytes], Any], seconds: float | None = None) -> None:
    """A table function ``name(content)``: a row per page, or one row with the error. Null content is one."""

    def pages(content: bytes | None) -> list[tuple]:
        if content is None:
            raise ValueError("no content")
        out = []
        for no, raw in enumerate(extractor(bytes(content)), 1):
            text = raw.get("text") or ""
            if not isinstance(text, str):
                raise TypeError(f"the text of page {no} is {type(text).__name__}, not str")
            tables = [[[str(c or "") for c in row] for row in table] for table in raw.get("tables") or []]
            out.append((no, text, tables, [None if i is None else bytes(i) for i in raw.get("images") or []], None))
        return out

    class Pages:
        def __init__(self) -> None:
            self.call = Calls(pages, seconds)

        def eval(self, content: bytes) -> Iterator[tuple]:
            found, error = self.call(content)
            yield from [(None, None, None, None, error)] if error is not None else found

        def terminate(self) -> Iterator[tuple]:
            self.call.close()
            yield from ()

    spark.udtf.register(name, udtf(Pages, returnType=PAGE))


def register_transform(spark: SparkSession, name: str, transform: Callable[[str], str], seconds: float | None = None) -> None:
    """A table function ``name(text)``: one row with the result or the error."""

    def textual(text: str | None) -> str:
        if text is None:
            raise ValueError("no text")
        answer = transform(text)
        if not isinstance(answer, str):
            raise TypeError(f"the transform gave {type(answer).__name__}, not str")
        return answer

    class Answers:
        def __init__(self) -> None:
            self.call = Calls(textual, seconds)

        def eval(self, text: str) -> Iterator[tuple]:
            yield self.call(text)

        def terminate(self) -> Iterator[tuple]:
            self.call.close()
            yield from ()

    spark.udtf.register(name, udtf(Answers, returnType=ANSWER))
