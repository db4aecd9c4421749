"""Benchmark items repeated without a gap: runs of any length, found in time that grows with their words."""

from __future__ import annotations

import random

import pytest
from brute import contaminated

from foliomark.llm import decontaminate


def found(spark, docs, items):
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    things = spark.createDataFrame(items, "item_id string, text string")
    return {r.doc_id: (r.n_words, r.n_hit, sorted(r.item_ids), r.spans) for r in decontaminate.contained_items(rows, things).collect()}


@pytest.mark.parametrize("repeats", [450, 5000])
def test_one_item_repeated(spark, repeats):
    item = " ".join(f"w{k}" for k in range(40))
    found_rows = found(spark, [(1, " ".join([item] * repeats)), (2, "w0 w1"), (3, None)], [("a", item)])
    assert found_rows[1][:3] == (40 * repeats, 40 * repeats, ["a"]) and len(found_rows[1][3]) == 1
    assert found_rows[2][:3] == (2, 0, []) and found_rows[3][:3] == (0, 0, [])


def test_runs_around_the_size_of_a_piece(spark):
    """Items of many lengths in runs that end anywhere near a cut."""
    rng = random.Random(8)
    vocabulary = [f"v{k}" for k in range(25)]
    items = [(f"i{k}", " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 9, 10, 11, 30, 70])))) for k in range(12)]
    docs = []
    for k in range(60):
        parts = [rng.choice(items)[1] if rng.random() < 0.6 else " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(1, 8))]
        docs.append((k, " ".join(parts)))
    got = found(spark, docs, items)
    for (doc_id, _), row in zip(docs, contaminated(docs, items), strict=True):
        assert got[doc_id][:3] == row[1:]
        assert sum(s["last"] - s["first"] for s in got[doc_id][3]) == got[doc_id][1]
        assert all(a["last"] < b["first"] for a, b in zip(got[doc_id][3], got[doc_id][3][1:]))
