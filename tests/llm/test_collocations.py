"""Collocations against a plain count, hot prefixes cut into parts, and hashes that clash."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np

from foliomark.llm import collocations as coll

SCHEMA = "doc_id long, text string, lang string, a int, l int, r int, n int, rank int, phrase string, word long"
COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def brute(rows, least=10, most=2000):
    f = {}
    for text, lang in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(UPPER)):
            words = re.findall("[^\x20\x09]+", piece)
            counts = f.setdefault(lang or "und" if lang is None else lang, Counter())
            for k in (1, 2, 3):
                counts.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        n = sum(v for g, v in counts.items() if len(g) == 1)
        good = {g: a for g, a in counts.items() if len(g) > 1 and a >= least}
        inside = Counter()
        for g, a in good.items():
            if len(g) == 3:
                for part in (g[:2], g[1:]):
                    inside[part] = max(inside[part], a)
        found = []
        for g, a in good.items():
            cuts = [(1_000_000 * a * a // (counts[g[:k]] * counts[g[k:]]), k, counts[g[:k]], counts[g[k:]]) for k in range(1, len(g))]
            if not (g in inside and 100 * inside[g] >= 50 * a):
                score, _, left, right = min(cuts)
                found.append((-score, -a, " ".join(g).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:most], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


def found(spark, rows, **options):
    docs = spark.createDataFrame([(k, t, x, 1, 2, 3, 4, 5, "p", 6) for k, (t, x) in enumerate(rows)], SCHEMA)
    return sorted(tuple(r) for r in coll.collocations(docs, **options).select(*COLUMNS).collect())


def texts(rng, n):
    vocabulary = ["the", "The", "of", "new", "york", "City", "é", "É", "日本", "x-y", "don't", "\x00", " "] + [f"w{k}" for k in range(40)]
    rows = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(0, 60)):
            parts.append(rng.choice(["New York City", "of the", "new york", rng.choice(vocabulary), rng.choice(vocabulary)]))
            parts.append(rng.choice([" ", " ", " ", "\t", "  ", ", ", ".", "\n", " ! ", "\x0b"]))
        rows.append(("".join(parts), rng.choice(["en", "de", None, "und", ""])))
    return rows


def test_against_plain_counts(spark):
    rows = texts(random.Random(1), 300)
    rows += [(None, "en"), ("", None), (" .,\n", "fr"), ("one", "xx"), rows[0], rows[0], ("so " * 20_000 + "end", "en")]
    assert found(spark, rows) == brute(rows)
    assert found(spark, rows, most=3) == brute(rows, most=3)
    assert found(spark, rows, least=25, most=None) == brute(rows, 25, 10**9)


def test_parts_of_hot_prefixes(spark, monkeypatch):
    """Small chunks, so stripes arrive in many fragments, and nearly every prefix is hot."""
    monkeypatch.setattr(coll, "CHUNK", 500)
    monkeypatch.setattr(coll, "HELD", 100)
    monkeypatch.setattr(coll, "HOT", 100_000)
    rows = texts(random.Random(2), 200)
    assert found(spark, rows) == brute(rows)


def test_small_tables(spark):
    for rows in ([], [(None, None)], [("a b", "en")], [("a b a b a b a b a b a b a b a b a b a b", None)]):
        assert found(spark, rows) == brute(rows)


def test_clashing_hashes_are_noticed(spark, monkeypatch):
    seeds = []
    strong = coll._counted_words

    def weak(docs, seed):
        seeds.append(seed)
        words = strong(docs, seed)
        return words.selectExpr("word", "lang", "text", "n", "true AS clash") if seed == 0 else words

    monkeypatch.setattr(coll, "_counted_words", weak)
    rows = texts(random.Random(3), 60)
    assert found(spark, rows) == brute(rows)
    assert seeds == [0, 1]


def test_two_spellings_of_a_hash_clash():
    word = np.array([7, 7, 8, 9, 9], dtype=np.uint64)
    check = np.array([1, 2, 1, 3, 3], dtype=np.uint64)
    uniq, first, total, clash = coll.once(word, check, np.array([1, 2, 3, 4, 5]), np.array([False, False, True, False, False]))
    assert uniq.tolist() == [7, 8, 9] and first.tolist() == [0, 2, 3]
    assert total.tolist() == [3, 3, 9] and clash.tolist() == [True, True, False]


def test_large_counts_stay_exact(spark):
    row = spark.range(1).selectExpr("3000000000000L AS a", "3000000000001L AS l", "4000000000003L AS r")
    assert row.select(coll._score("a", "l", "r").alias("s")).first().s == 1_000_000 * 3000000000000**2 // (3000000000001 * 4000000000003)
