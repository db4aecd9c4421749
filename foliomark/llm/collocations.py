"""Collocations by the stripes pattern: a prefix keys an associative counter of the words that follow it.

A stripe is {next word: count}; stripes of one prefix merge elementwise, so tasks send partial ones and
merging is a sum in any order. Whatever follows that cannot matter (the end of a piece, a word or pair
that is too rare) counts under one entry, so a merged stripe gives, exactly and at once

- the extensions of the prefix: phrases with their counts,
- the prefix's total: how often it occurs at all,
- the maximum over its extensions, which decides what a longer phrase subsumes.

Words are read three times. The first counts them; the second makes the stripes of single words, for
phrases of two; the third those of frequent pairs, for phrases of three. A phrase is frequent only if
all its parts are, so each reading needs only what the one before found; a bit table tells that, and
what it lets through by chance is dropped by its count.

A prefix with more than 1 in ``HOT`` of all words has its stripe cut by the hash of the next word into as many
parts as it has such shares, and a merging task holds one merged part, never the sum of what arrives.

Words are 64-bit hashes (of language and spelling) until the end. The first reading compares the
spellings of each hash, within a task by a second hash; if two share one, all is done again with
another seed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliomark.llm.bits import bit_table, contains
from foliomark.llm.tables import table
from foliomark.llm.words import byte_values, bytes_outside, lowered, mixed, ragged, signed, slices, text_bytes, word_hashes, word_spans
from foliomark.operators.spool import Scratch

LEAST = 10
MOST = 2000
#: percent of a phrase's occurrences inside one longer phrase that make it a part of that
SUBSUMED = 50
HOT = 4096
#: slices of a language that are ranked apart first
RANKED = 64
CHUNK = 1 << 20
HELD = 1 << 19
OTHER = 0
_PAIR = np.uint64(0x9E3779B97F4A7C15)

#: fixed values: `[.,;:!?\x0A-\x0D]` ends a piece, `[^\x20\x09]+` is a word of one
ENDS = ~bytes_outside(*((ord(c), ord(c)) for c in ".,;:!?"), (0x0A, 0x0D))
WORD = bytes_outside((0x20, 0x20), (0x09, 0x09)) & ~ENDS


class Words:
    """The words of some texts: hashes by language and lower-cased spelling, and which go on in the same piece."""

    def __init__(self, texts: pa.Array, langs: pa.Array, values: np.ndarray) -> None:
        self.raw, offsets = text_bytes(texts)
        self.starts, self.ends, begins = word_spans(self.raw, offsets, WORD)
        shown = pc.fill_null(langs, "und").dictionary_encode()
        seeds = np.array([xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) for x in shown.dictionary.to_pylist()], dtype=np.uint64)
        self.text = np.repeat(np.arange(len(texts)), np.diff(begins))
        self.langs = shown
        self.seeds = seeds[shown.indices.to_numpy()][self.text] if len(self.text) else np.empty(0, np.uint64)
        self.hashes = self.hashed(values)
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(ENDS[self.raw])])
        self.joined = np.zeros(len(self.hashes), dtype=bool)
        if len(self.hashes) > 1:
            self.joined[:-1] = (ends[self.starts[1:]] == ends[self.ends[:-1]]) & (self.text[1:] == self.text[:-1])

    def hashed(self, values: np.ndarray) -> np.ndarray:
        return np.maximum(mixed(word_hashes(self.raw, self.starts, self.ends, values) + self.seeds), np.uint64(1))

    def spelled(self, at: np.ndarray) -> pa.Array:
        sizes = self.ends[at] - self.starts[at]
        data = lowered(self.raw[ragged(self.starts[at], sizes)])
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(data)).cast(pa.string())


def _words_of(batch: pa.RecordBatch, values: np.ndarray) -> Iterator[Words]:
    for part in slices(batch):
        yield Words(part.column("text"), part.column("lang"), values)


def once(word: np.ndarray, check: np.ndarray, n: np.ndarray, clash: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct hashes, where they are first, their sums, and whether another spelling has one."""
    uniq, first, inverse = np.unique(word, return_index=True, return_inverse=True)
    total, mixed_up = np.zeros(len(uniq), dtype=np.int64), np.zeros(len(uniq), dtype=bool)
    np.add.at(total, inverse, n)
    np.logical_or.at(mixed_up, inverse, clash | (check != check[first][inverse]))
    return uniq, first, total, mixed_up


def _counted_words(docs: DataFrame, seed: int) -> DataFrame:
    """(word, lang, text, n, clash): every word of every language; ``clash`` where a hash has two spellings."""
    values, others = byte_values(True, seed), byte_values(True, ~seed & 0xFFFF_FFFF)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out() -> pa.RecordBatch:
            uniq, first, total, clash = once(*(np.concatenate([h[k] for h in held]) for k in range(4)))
            lang, text = (pa.chunked_array([h[k] for h in held], pa.string()).combine_chunks().take(pa.array(first)) for k in (4, 5))
            held.clear()
            return pa.record_batch({"word": signed(uniq), "lang": lang, "text": text, "n": total, "clash": clash})

        for batch in batches:
            for words in _words_of(batch, values):
                if len(words.hashes):
                    check = words.hashed(others)
                    ones = np.ones(len(check), dtype=np.int64)
                    uniq, first, n, clash = once(words.hashes, check, ones, np.zeros(len(check), dtype=bool))
                    langs = words.langs.take(pa.array(words.text[first])).cast(pa.string())
                    held.append((uniq, check[first], n, clash, langs, words.spelled(first)))
                if sum(len(h[0]) for h in held) > HELD:
                    yield out()
        if held:
            yield out()

    rows = docs.mapInArrow(run, "word long, lang string, text string, n long, clash boolean").repartition("word")
    spellings = rows.groupBy("word").agg(F.sum("n").alias("n"), F.max("clash").alias("here"), *[f(c).alias(f"{c}_{f.__name__}") for c in ("lang", "text") for f in (F.min, F.max)])
    clash = F.col("here") | (F.col("lang_min") != F.col("lang_max")) | (F.col("text_min") != F.col("text_max"))
    return spellings.select("word", F.col("lang_min").alias("lang"), F.col("text_min").alias("text"), "n", clash.alias("clash"))


def _dense(*columns: np.ndarray) -> list[np.ndarray]:
    """The same columns with small numbers for the values."""
    _, inverse = np.unique(np.concatenate(columns), return_inverse=True)
    return np.split(inverse.astype(np.int64), np.cumsum([len(c) for c in columns])[:-1])


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mixed(a * _PAIR + b)


class Shares:
    """Parts of the stripes of hot prefixes, by prefix hash."""

    def __init__(self, hot: list[tuple[int, int]]) -> None:
        rows = sorted(hot)
        self.keys = np.array([k for k, _ in rows], dtype=np.int64)
        self.parts = np.array([p for _, p in rows], dtype=np.int64)

    def part(self, prefix: np.ndarray, following: np.ndarray) -> np.ndarray:
        """The part of each entry; what does not matter is in the first."""
        if not len(self.keys):
            return np.zeros(len(prefix), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.keys, signed(prefix)), len(self.keys) - 1)
        parts = np.where(self.keys[at] == signed(prefix), self.parts[at], 1)
        return np.where(following == OTHER, 0, (mixed(following) % parts.astype(np.uint64)).astype(np.int64))


STRIPE = "a long, b long, part int, next array<long>, n array<long>"


def _stripes(docs: DataFrame, seed: int, words: int, frequent: Broadcast, shares: Shares) -> DataFrame:
    """Partial stripes of single words (``b`` is 0) or of pairs."""
    values = byte_values(True, seed)

    def entries(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = w.hashes
        following = np.append(h[1:], np.uint64(0))
        if words == 1:
            known = contains(frequent.value, h)
            after = w.joined & np.append(known[1:], False)
            return h[known], np.zeros(int(known.sum()), np.uint64), np.where(after, following, np.uint64(OTHER))[known]
        known = np.zeros(len(h), dtype=bool)
        at = np.flatnonzero(w.joined)
        known[at] = contains(frequent.value, pair_hash(h[at], following[at]))
        after = np.append(known[1:], False)
        third = np.append(following[1:], np.uint64(0))
        return h[known], following[known], np.where(after, third, np.uint64(OTHER))[known]

    def combined(held: list[tuple]) -> pa.RecordBatch:
        a, b, following = (np.concatenate([h[k] for h in held]) for k in range(3))
        held.clear()
        da, db, dn = _dense(a, b, following)
        prefix = _dense(da << 32 | db)[0] if words > 1 else da
        _, at, n = np.unique(prefix << 32 | dn, return_index=True, return_counts=True)
        a, b, following, prefix = a[at], b[at], following[at], prefix[at]
        part = shares.part(a if words == 1 else pair_hash(a, b), following)
        if part.any():
            order = np.lexsort((part, prefix))
            a, b, following, prefix, part, n = (x[order] for x in (a, b, following, prefix, part, n))
        starts = np.concatenate([[0], np.flatnonzero((prefix[1:] != prefix[:-1]) | (part[1:] != part[:-1])) + 1])
        offsets = np.append(starts, len(n)).astype(np.int32)
        lists = [pa.ListArray.from_arrays(offsets, x) for x in (signed(following), n.astype(np.int64))]
        return pa.record_batch({"a": signed(a[starts]), "b": signed(b[starts]), "part": part[starts].astype(np.int32), "next": lists[0], "n": lists[1]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for w in _words_of(batch, values):
                found = entries(w)
                if len(found[0]):
                    held.append(found)
                if sum(len(h[0]) for h in held) > CHUNK:
                    yield combined(held)
        if held:
            yield combined(held)

    return docs.mapInArrow(run, STRIPE)


MERGED = "a long, b long, part int, total long, longest long, next array<long>, n array<long>, pair array<long>"


def _merged(stripes: DataFrame, least: int) -> DataFrame:
    """Whole stripes: total, greatest extension, and the extensions of at least ``least`` with a hash of their pair."""

    def summed(rows: list[tuple]) -> list[np.ndarray]:
        """Columns a, b, part, next, n of sorted rows, equal ones added up."""
        a, b, part, following, n = (np.concatenate([r[k] for r in rows]) for k in range(5))
        group = np.concatenate([[0], np.cumsum((a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (part[1:] != part[:-1]))])
        _, at, inverse = np.unique(group << 32 | _dense(following)[0], return_index=True, return_inverse=True)
        total = np.zeros(len(at), dtype=np.int64)
        np.add.at(total, inverse, n)
        return [a[at], b[at], part[at], following[at], total]

    def whole(rows: list[np.ndarray]) -> pa.RecordBatch:
        a, b, part, following, n = rows
        starts = np.concatenate([[0], np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (part[1:] != part[:-1])) + 1])
        good = (following != OTHER) & (n >= least)
        offsets = np.concatenate([[0], np.cumsum(np.add.reduceat(good.astype(np.int64), starts))]).astype(np.int32)
        pairs = pair_hash(a[good].view(np.uint64), following[good].view(np.uint64))
        lists = [pa.ListArray.from_arrays(offsets, x) for x in (following[good], n[good], signed(pairs))]
        return pa.record_batch(
            {
                "a": a[starts], "b": b[starts], "part": part[starts], "total": np.add.reduceat(n, starts),
                "longest": np.maximum.reduceat(np.where(good, n, 0), starts), "next": lists[0], "n": lists[1], "pair": lists[2],
            }
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = pc.list_value_length(batch.column("next")).to_numpy()
            rows = [np.repeat(batch.column(c).to_numpy(), sizes) for c in ("a", "b", "part")]
            rows += [batch.column(c).flatten().to_numpy() for c in ("next", "n")]
            rows = summed([held, rows] if held is not None else [rows])
            a, b, part = rows[:3]
            # the last stripe may go on in the next batch; it waits merged
            same = (a == a[-1]) & (b == b[-1]) & (part == part[-1])
            cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if cut:
                yield whole([x[:cut] for x in rows])
            held = [x[cut:] for x in rows]
        if held is not None:
            yield whole(held)

    key = ["a", "b", "part"]
    return stripes.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, MERGED)


def _hot(counts: DataFrame, key: str, total: int) -> Shares:
    """Prefixes with more than 1 in HOT of all words; they are fewer than HOT."""
    share = F.ceil(F.col("n") * F.lit(HOT) / F.lit(total)).cast("long")
    rows = counts.filter(F.col("n") * F.lit(HOT) > F.lit(total)).select(key, share).collect()
    return Shares([(k, s) for k, s in rows])


def _table_bits(n: int) -> int:
    """Bits that keep a table of n values sparse, up to 32 MB."""
    return min(28, max(16, (16 * n).bit_length()))


def _extensions(merged: DataFrame) -> DataFrame:
    each = F.explode(F.arrays_zip("next", "n", "pair"))
    return merged.select("a", "b", each.alias("e")).select("a", "b", F.col("e.next").alias("c"), F.col("e.n").alias("n"), F.col("e.pair").alias("pair"))


def _score(a: str, left: str, right: str):  # noqa: ANN202
    """floor(1000000 * a * a / (left * right)) in decimals of 38 digits, exact for counts below 10**16."""
    a, left, right = (f"cast({x} as decimal(19,0))" for x in (a, left, right))
    return F.expr(f"({a} * {a} * cast(1000000 as decimal(7,0))) div ({left} * {right})")


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, most: int | None = MOST, subsumed: int = SUBSUMED
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the first ``most`` phrases of two and three words of each language.

    Null texts are empty, a null language is ``und``; repeated rows count each time; a text of any length
    is read whole. Phrases with equal score are ordered by count, then by their bytes, so ties are settled.
    ``most=None`` gives all candidates, which then one task per language ranks. A language without candidates has no rows.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    for seed in count():
        scratch = Scratch(spark, "collocations")
        words = scratch.spool(_counted_words(texts, seed))
        if words.filter("clash").isEmpty():
            break
    total, known = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(F.col("n") >= least, 1))).first()
    frequent = words.filter(F.col("n") >= least).select("word", "lang", "text", "n")

    bits = bit_table(frequent, "word", _table_bits(known))
    ones = scratch.spool(_merged(_stripes(texts, seed, 1, bits, _hot(frequent, "word", total)), least))
    totals = ones.groupBy("a").agg(F.sum("total").alias("l"))
    first = frequent.select(F.col("word").alias("a"), "lang", F.col("text").alias("first"))
    second = frequent.select(F.col("word").alias("c"), F.col("text").alias("second"), F.col("n").alias("r"))
    pairs = _extensions(ones).drop("b").join(totals, "a").join(first, "a").join(second, "c")
    pairs = scratch.spool(pairs.select("a", F.col("c").alias("b"), "pair", "n", "l", "r", "lang", "first", "second"))

    bits = bit_table(pairs, "pair", _table_bits(pairs.count()))
    twos = scratch.spool(_merged(_stripes(texts, seed, 2, bits, _hot(pairs, "pair", total)), least))
    triples = _extensions(twos).drop("pair")
    head = pairs.select("a", "b", F.col("n").alias("ab"), F.col("l").alias("la"), "lang", "first", "second")
    tail = pairs.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("n").alias("bc"), F.col("r").alias("rc"), F.col("second").alias("third"))
    triples = scratch.spool(triples.join(head, ["a", "b"]).join(tail, ["b", "c"]))

    # the greatest count of a phrase of three around each pair: the maximum of its stripe, and of the stripes it ends
    before = twos.filter("longest > 0").select("a", "b", F.col("longest").alias("around"))
    after = triples.groupBy("b", "c").agg(F.max("n").alias("around")).select(F.col("b").alias("a"), F.col("c").alias("b"), "around")
    around = before.unionAll(after).groupBy("a", "b").agg(F.max("around").alias("around"))
    alone = pairs.join(around, ["a", "b"], "left").filter(F.col("around").isNull() | (F.col("around") * 100 < F.col("n") * subsumed))
    two = alone.select("lang", F.concat_ws(" ", "first", "second").alias("phrase"), F.col("n").alias("a"), "l", "r", _score("n", "l", "r").alias("score"))
    cuts = triples.select(
        "lang", F.concat_ws(" ", "first", "second", "third").alias("phrase"), "n",
        F.struct(_score("n", "la", "bc").alias("score"), F.lit(1).alias("k"), F.col("la").alias("l"), F.col("bc").alias("r")).alias("one"),
        F.struct(_score("n", "ab", "rc").alias("score"), F.lit(2).alias("k"), F.col("ab").alias("l"), F.col("rc").alias("r")).alias("two"),
    )
    three = cuts.withColumn("cut", F.least("one", "two")).select("lang", "phrase", F.col("n").alias("a"), "cut.l", "cut.r", "cut.score")
    found = two.unionByName(three)
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    if most is not None:
        # first within slices of a language, so that no task sorts all of its phrases
        slices_of = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(RANKED)))
        found = found.withColumn("rank", F.row_number().over(slices_of.orderBy(*order))).filter(F.col("rank") <= most)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    sizes = words.groupBy("lang").agg(F.sum("n").alias("n"))
    listed = (found if most is None else found.filter(F.col("rank") <= most)).join(sizes, "lang")
    return listed.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of every language of all documents."""
    return collocations(table(spark, sf_dir, "documents", "text", "lang"))


def op13_sql() -> str:
    return rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang,
                  unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
           FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p),
i AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM w),
g AS (SELECT lang, words[i:i + k - 1] AS g FROM i, (VALUES (1), (2), (3)) s(k) WHERE i + k - 1 <= len(words)),
f AS MATERIALIZED (SELECT lang, array_to_string(g, ' ') AS g, len(g) AS size, g AS words, count(*) AS f FROM g GROUP BY ALL),
s AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT * FROM f WHERE size > 1 AND f >= {LEAST}),
t AS MATERIALIZED (SELECT lang, g, f AS a, size, cut, array_to_string(words[1:cut], ' ') AS x, array_to_string(words[cut + 1:], ' ') AS y
      FROM (SELECT *, unnest(range(1, size)) AS cut FROM c)),
k AS (SELECT t.lang, t.g, t.a, x.f AS l, y.f AS r, cut, ((1000000::HUGEINT * t.a * t.a) // (x.f::HUGEINT * y.f))::BIGINT AS score
      FROM t JOIN f x ON x.lang = t.lang AND x.g = t.x JOIN f y ON y.lang = t.lang AND y.g = t.y),
b AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1),
m AS (SELECT lang, g, max(a) AS f FROM (SELECT lang, x AS g, a FROM t WHERE size = 3 AND cut = 2 UNION ALL SELECT lang, y, a FROM t WHERE size = 3 AND cut = 1) GROUP BY lang, g),
d AS (SELECT b.* FROM b LEFT JOIN m USING (lang, g) WHERE m.f IS NULL OR 100 * m.f < {SUBSUMED} * b.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank, g AS phrase, a, l, r, n, score
FROM d JOIN s USING (lang) QUALIFY rank <= {MOST}
"""
