"""Language identification as inference of a mixture.

A language is a distribution over hashed letter trigrams, counted over all labelled texts. In a text
every word comes from one of the languages; expectation-maximisation estimates the proportions from
the words' likelihoods, until no proportion moves. It runs over sets of one language and more, those with the largest
proportions, and the set with the best penalised likelihood counts. A text's sets grow up to all
languages, as long as the likelihood that any mixture could reach outweighs the penalty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomark.llm.tables import map_batches, table
from foliomark.llm.words import bytes_outside, slices, text_bytes, word_spans

#: at most so many numbers in the model, whatever the number of languages and texts (64 MB)
CELLS = 1 << 24
MOST_BITS = 16
SMOOTHING = 0.5
#: expectation-maximisation of a text ends when no proportion moves by more
STILL = 1e-4
FLOOR = -14.0
SLICE = 1 << 20
HELD_LANGUAGES = 64
UNDETERMINED = "und"

#: ASCII letters and all of other scripts
LETTERS = bytes_outside((0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F))


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # (buckets, languages), log probabilities

    @property
    def bits(self) -> int:
        return len(self.scores).bit_length() - 1


def _grams(texts: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the trigrams of all words, where each word's begin, and the words before each text."""
    raw, offsets = text_bytes(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    starts, ends, begins = word_spans(raw, offsets, LETTERS)
    sizes = ends - starts
    # each word as its bytes and a final zero; a trigram ends at every byte, zeros stand before the first
    first = np.cumsum(sizes + 1) - (sizes + 1)
    total = int((sizes + 1).sum())
    letters = np.zeros(total + 2, dtype=np.uint32)
    at = np.ones(total, dtype=bool)
    at[first + sizes] = False
    letters[2:][at] = raw[LETTERS[raw]]
    before = letters[:-2].copy()
    before[first] = 0  # two bytes back is the word before
    code = (before << np.uint32(16)) | (letters[1:-1] << np.uint32(8)) | letters[2:]
    return (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits), first, begins


def gram_counts(labelled: DataFrame, bits: int) -> DataFrame:
    """(lang, bucket, n) for ``labelled(text, lang)``; counts are summed per task before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, n in sums.items():
                some = np.flatnonzero(n)
                yield pa.record_batch({"lang": pa.array([lang] * len(some), pa.string()), "bucket": pa.array(some, pa.int32()), "n": pa.array(n[some])})
            sums.clear()

        for batch in batches:
            for part in slices(batch, limit=SLICE):
                codes, first, begins = _grams(part.column("text"), bits)
                ends = np.concatenate([first, [len(codes)]])[begins]
                langs = part.column("lang").to_pylist()
                for lang in sorted(set(langs)):
                    if lang not in sums and len(sums) >= HELD_LANGUAGES:
                        yield from flush()
                    of = np.repeat(np.array([x == lang for x in langs]), np.diff(ends))
                    sums[lang] = sums.get(lang, 0) + np.bincount(codes[of], minlength=1 << bits)
        yield from flush()

    return labelled.select("text", "lang").mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def train(labelled: DataFrame) -> Model:
    """The model of ``labelled(text, lang)``; rows without text or lang teach nothing.

    What comes to the driver has at most ``CELLS`` rows: the more languages, the fewer buckets.
    """
    labelled = labelled.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).dropna()
    count = labelled.select("lang").distinct().count()
    bits = max(8, min(MOST_BITS, (CELLS // max(1, count)).bit_length() - 1))
    rows = gram_counts(labelled, bits).toArrow()
    languages = sorted(pc.unique(rows["lang"]).to_pylist())
    counts = np.zeros((1 << bits, len(languages)))
    if languages:
        where = {lang: k for k, lang in enumerate(languages)}
        counts[rows["bucket"].to_numpy(), [where[x] for x in rows["lang"].to_pylist()]] = rows["n"].to_numpy()
    scores = np.log((counts + SMOOTHING) / (counts.sum(axis=0) + SMOOTHING * len(counts)))
    return Model(languages, scores.astype(np.float32))


def _settled(likely: np.ndarray, shares: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where expectation-maximisation settles from ``shares``, and the log likelihood before its last step.

    ``n`` is the number of words of each text. A text is done when none of its proportions moves by more
    than ``STILL``, whatever other texts it lies with; every step raises its likelihood, so this ends.
    """
    out, value = shares.copy(), np.zeros(len(shares))
    open_ = np.arange(len(shares))
    while len(open_):
        begins = np.concatenate([[0], np.cumsum(n)[:-1]])
        joint = likely * np.repeat(shares, n, axis=0)
        each = joint.sum(axis=1)
        joint /= each[:, None]
        after = np.add.reduceat(joint, begins, axis=0, dtype=np.float64) / n[:, None]
        moving = np.abs(after - shares).max(axis=1) > STILL
        out[open_], value[open_] = after, np.add.reduceat(np.log(each), begins, dtype=np.float64)
        likely, shares, open_, n = likely[np.repeat(moving, n)], after[moving].astype(np.float32), open_[moving], n[moving]
    return out, value


def _bound(likely: np.ndarray, shares: np.ndarray, text: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """What no mixture's log likelihood exceeds: it is concave, so its slopes at ``shares`` bound it."""
    each = (likely * shares[text]).sum(axis=1)
    sizes = np.diff(begins)
    slope = (np.add.reduceat(likely / each[:, None], begins[:-1], axis=0) / sizes[:, None]).max(axis=1)
    return np.add.reduceat(np.log(each), begins[:-1]) + sizes * np.log(slope) + 1e-3 * sizes + 1e-6


def proportions(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(texts, languages) proportions, 0 outside the chosen set, and the number of words; 0 words: all 0."""
    codes, first, begins = _grams(texts, model.bits)
    n_words = np.diff(begins)
    some = np.flatnonzero(n_words)
    out = np.zeros((len(n_words), len(model.languages)), dtype=np.float32)
    if not len(some) or not model.languages:
        return out, n_words
    words = np.add.reduceat(model.scores[codes], first, axis=0)
    likely = np.exp(np.maximum(words - words.max(axis=1, keepdims=True), np.float32(FLOOR)))
    begins = np.concatenate([begins[:-1][some], begins[-1:]])
    text = np.repeat(np.arange(len(some)), np.diff(begins))
    n, count = np.diff(begins), len(model.languages)
    even = np.full((len(some), count), 1 / count, dtype=np.float32)
    shares, _ = _settled(likely, even, n)
    rank = np.argsort(np.argsort(-shares, axis=1, kind="stable"), axis=1, kind="stable")
    best = np.full(len(some), -np.inf)
    chosen = np.zeros_like(shares)
    bound = _bound(likely, shares, text, begins)
    for size in range(1, count + 1):
        penalty = (size - 1) * np.log(n + 1) + size * np.log(count)
        open_ = np.flatnonzero(bound - penalty > best)
        if not len(open_):
            break
        # only the words of texts that a larger set may still fit better
        is_open = np.zeros(len(n), dtype=bool)
        is_open[open_] = True
        own = likely[is_open[text]]
        start = np.where(rank[open_] < size, shares[open_] + np.float32(1e-6), 0).astype(np.float32)
        start /= start.sum(axis=1, keepdims=True)
        found, value = _settled(own, start, n[open_])
        value = value - penalty[open_]
        better = value > best[open_]
        best[open_[better]], chosen[open_[better]] = value[better], found[better]
    out[some] = chosen
    return out, n_words


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> (row columns, lang_pred, score, languages, proportions).

    All columns of ``docs`` stay, except those with the four new names. ``lang_pred`` is the language
    with the largest proportion (of equal ones the first by name) and ``score`` that proportion,
    smoothed by half a word for each language. ``und`` with score 0 if the text is null or has no letter, or the
    model knows no language.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    new = {"lang_pred": "string", "score": "double", "languages": "array<string>", "proportions": "array<double>"}
    rows = docs.drop(*new)

    def step():  # noqa: ANN202
        model = held.value

        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for part in slices(batch, limit=SLICE):
                text = part.column("text")
                letters = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_pylist()
                shares, words = proportions(model, text)
                preds, scores, sets, parts = [], [], [], []
                for share, n, any_letter in zip(shares, words.tolist(), letters, strict=True):
                    if not any_letter or not model.languages:
                        preds.append(UNDETERMINED), scores.append(0.0), sets.append([]), parts.append([])
                        continue
                    order = [k for k in np.argsort(-share, kind="stable").tolist() if share[k] > 0]
                    preds.append(model.languages[order[0]])
                    scores.append(min(1.0, (float(share[order[0]]) * n + 0.5) / (n + 0.5 * len(model.languages))))
                    sets.append([model.languages[k] for k in order])
                    parts.append([float(share[k]) for k in order])
                columns = [*part.columns, pa.array(preds, pa.string()), pa.array(scores, pa.float64()),
                           pa.array(sets, pa.list_(pa.string())), pa.array(parts, pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names, *new])

        return each

    fields = ", ".join([*(f"`{name}` {kind}" for name, kind in rows.dtypes), *(f"{name} {kind}" for name, kind in new.items())])
    return map_batches(rows, step, fields)


def held_out(doc_id: Column) -> Column:
    """The fifth of the documents that teaches nothing; null counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def predicted(docs: DataFrame) -> DataFrame:
    """Trained on the labelled documents outside the held-out fifth, applied to all."""
    model = train(docs.filter(~held_out(F.col("doc_id"))).select("text", "lang"))
    return identify(docs, model)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text of documents."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = train(docs.filter(~held_out(F.col("doc_id"))).select("text", "lang"))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "languages", "proportions")
