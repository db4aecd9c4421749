"""The trie against a plain statement on small tables, its monoid, and the proof against weak hashes."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import xxhash
from pyspark.sql import functions as F

from foliomark.llm import prefix_trie as trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, c string, d string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            tie = np.uint64(xxhash.xxh64_intdigest((text or "").encode(), seed=42)).astype(np.int64)
            own[conv].append((turn is not None, turn or 0, role or "", tie, text or ""))
    stored = {c: [(t[2], t[4]) for t in sorted(turns)] for c, turns in own.items()}
    rebuilt = {}
    for c, turns in stored.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = tuple(stored.get(c - c % 100, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c in sorted(rebuilt):
        for d in range(len(rebuilt[c]) + 1):
            members[rebuilt[c][:d]].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)

    def below(node):
        leaves, saved, todo = 0, 0, [node]
        while todo:
            x = todo.pop()
            leaves += not children[x]
            saved += (len(members[x]) - 1) * len(x[-1][1]) if x else 0
            todo += children[x]
        return leaves, saved

    out = []
    for node, held in members.items():
        ends = ",".join(str(c) for c in held if len(rebuilt[c]) == len(node))
        parent = members[node[:-1]][0] if node else None
        out.append((held[0], len(node), parent, len(held), len(children[node]), *below(node), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def table_of(spark, rows):
    return spark.createDataFrame([(*r, None, None, "x") for r in rows], SCHEMA)


def found(spark, rows):
    return sorted((tuple(r) for r in trie.prefix_trie(table_of(spark, rows)).select(*COLUMNS).collect()), key=repr)


def conversations(rng, n, most=7):
    rows = []
    for _ in range(n):
        c = rng.choice([rng.randrange(250), rng.randrange(250), rng.randrange(10**12)])
        rows += [(c, rng.choice([k, k, None, 3]), rng.choice(["user", "bot", None]), rng.choice(["a", "b", "", None, "lång", "👍"])) for k in range(rng.randint(1, most))]
    return rows


def test_against_brute_force(spark):
    rng = random.Random(2)
    rows = conversations(rng, 300)
    rows += [(None, 1, "user", "nobody's"), *rows[:5], (7, None, None, None), (7, None, None, None)]
    assert found(spark, rows) == brute(rows)


def test_long_paths_and_parts(spark, monkeypatch):
    """Conversations far longer than a block, one with most of all turns, and copies of it."""
    monkeypatch.setattr(trie, "SPAN", 5)
    monkeypatch.setattr(trie, "PIECE", 3)
    rng = random.Random(3)
    rows = conversations(rng, 60)
    long = [("user", rng.choice("ab")) for _ in range(400)]
    for c in (1001, 1002, 1003, 1100, 1105, 1106):
        for k, turn in enumerate(long[: rng.choice([400, 400, 390, 37])]):
            rows.append((c, k, *turn))
    rows += [(c, 0, "user", "same") for c in range(2000, 2060)]
    assert found(spark, rows) == brute(rows)


def test_small_tables(spark):
    assert found(spark, []) == []
    for rows in ([(5, None, None, None)], [(1, 0, "u", "x")], [(None, 0, "u", "x")], [(101, 0, "u", "x"), (102, 0, "u", "x")], [(0, 0, "u", "x"), (0, 0, "u", "x")]):
        assert found(spark, rows) == brute(rows)


def test_negative_and_large_ids(spark):
    rows = [(c, k, "u", "t") for c in (2**62, 2**62 + 1, 12345678901) for k in range(4)]
    assert found(spark, rows) == brute(rows)


def test_weak_hashes_are_noticed(spark, monkeypatch):
    """With hashes of a few values the first seeds fail their proof; the result is right all the same."""
    seeds = []
    strong = trie.stored_turns

    def weak(conversations, seed):
        seeds.append(seed)
        rows = strong(conversations, seed)
        return rows.withColumn("a", F.pmod("a", F.lit(2))).withColumn("b", F.pmod("b", F.lit(2))) if seed < 2 else rows

    monkeypatch.setattr(trie, "stored_turns", weak)
    rows = conversations(random.Random(5), 40)
    assert found(spark, rows) == brute(rows)
    assert seeds == [0, 1, 2]


def test_references_lead_to_the_last_turn(spark):
    rows = [(c, k, "u", f"{c if k > 1 else 0}-{k}") for c in (0, 1, 2, 3) for k in range(5)]
    nodes = trie.prefix_trie(table_of(spark, rows)).filter("depth > 0").collect()
    for r in nodes:
        assert r.ref.ref_pos < 5 and r.ref.ref_conv in (0, 1, 2, 3)
    assert len(nodes) == len(brute(rows)) - 1


def test_products_compose():
    rng = random.Random(1)
    turns = [rng.getrandbits(64) for _ in range(20)]

    def product(part):
        out = (0, 0, 0)
        for t in part:
            out = trie.composed(out, (1, t, t))
        return out

    for i in range(0, 20, 3):
        for j in range(i, 21, 4):
            assert trie.composed(trie.composed(product(turns[:i]), product(turns[i:j])), product(turns[j:])) == product(turns)
    exponents = np.array([0, 1, 5, -5, 1000])
    assert [int(x) for x in trie.powers(trie.BASES[0], exponents)] == [pow(trie.BASES[0], int(e), 1 << 64) for e in exponents]
