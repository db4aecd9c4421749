"""Quality: what heuristic labellers agree on, learnt without labels, trains a hashed linear scorer.

1. Each labeller votes, always the same, or abstains on a text, by counts made with column functions.
2. A label model: expectation-maximisation over the votes estimates the share of good texts and how
   often each labeller votes on good and on bad ones, and so how often it is right. Texts with the same votes are one row with a count,
   so it sees all texts in at most 2 ** labellers rows.
3. The posterior of each text's votes is its label. A logistic scorer over hashed word and shape
   features is fitted to the labels of at most ``FIT_ROWS`` texts, and scores every text. The sample is
   the texts with the least hashes of id and text, so that the same rows in other files or another order
   give the same scores.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomark.llm.tables import map_batches, table
from foliomark.llm.words import SPACED, byte_values, mixed, slices, text_bytes, word_hashes, word_spans
from foliomark.operators.spool import Scratch

#: votes
GOOD, BAD, ABSTAIN = 1, 0, -1
EM_ROUNDS = 200
EM_STOP = 1e-7
PRIOR = 1.0

FIT_ROWS = 6_000
FEATURE_BITS = 14
EPOCHS = 30
RATE = 0.5
DECAY = 1e-5
SEED = 11


def measures(text: Column) -> dict[str, Column]:
    """Counts the labellers need, from the text's characters and lines."""

    def count(pattern: str) -> Column:
        return F.char_length(text) - F.char_length(F.regexp_replace(text, pattern, ""))

    return {
        "chars": F.char_length(text),
        "letters": count(r"\p{L}+"),
        "upper": count(r"\p{Lu}+"),
        "marks": count(r"[^\p{L}\p{N}\s.,;:'’()-]+"),
        "spaces": count(r"\s+"),
        "stops": count(r"[.!?]+"),
        "lines": F.size(F.split(text, "\n")),
        "distinct_lines": F.size(F.array_distinct(F.split(text, "\n"))),
        "words": F.size(F.split(text, r"\s+")),
        "distinct_words": F.size(F.array_distinct(F.split(text, r"\s+"))),
    }


#: labellers and what they vote
VOTERS = {
    "marks": BAD, "letters": BAD, "upper": BAD, "repeats": BAD, "poor": BAD, "endless": BAD, "rich": GOOD, "sentences": GOOD,
}


def voters() -> dict[str, Column]:
    """Whether each labeller votes, over the columns of ``measures``; blank texts get all bad votes."""
    c = F.col
    words, chars = F.greatest(c("spaces"), F.lit(1)), F.greatest(c("chars"), F.lit(1))
    blank, stops = c("letters") == 0, c("stops") / words
    fires = {
        "marks": blank | (c("marks") / chars > 0.03),
        "letters": blank | (c("letters") / chars < 0.73),
        "upper": blank | (c("upper") / c("letters") > 0.3),
        "repeats": blank | (1 - c("distinct_lines") / c("lines") > 0.3),
        # texts get few new words as they grow, but more than twice the square root
        "poor": blank | (c("words") > 30) & (c("distinct_words") < 2 * F.sqrt("words")),
        "endless": blank | (stops < 0.01) & (c("spaces") > 30),
        "rich": ~blank & (c("distinct_words") > F.least(3 * F.sqrt("words"), 0.7 * c("words"))),
        "sentences": ~blank & (stops > 0.03) & (c("stops") <= c("words")),
    }
    return {name: F.when(fires[name], F.lit(vote)).otherwise(F.lit(ABSTAIN)) for name, vote in VOTERS.items()}


@dataclass
class LabelModel:
    good_share: float
    rates: np.ndarray  # (bad/good, labellers): how often each labeller votes on texts of a class

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability of good for rows of votes."""
        fired = (votes != ABSTAIN).astype(float)
        bad, good = (fired @ np.log(r) + (1 - fired) @ np.log(1 - r) for r in self.rates)
        total = good - bad + math.log(self.good_share / (1 - self.good_share))
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))

    def accuracy(self) -> dict[str, float]:
        """How often each labeller is right when it votes."""
        both = self.rates * np.array([[1 - self.good_share], [self.good_share]])
        return {name: float(both[vote, k] / both[:, k].sum()) for k, (name, vote) in enumerate(VOTERS.items())}


def fit_labels(votes: np.ndarray, weights: np.ndarray) -> LabelModel:
    """Expectation-maximisation from votes on: a text with a bad vote is rather bad, others rather good."""
    fired = (votes != ABSTAIN).astype(float)
    share = np.where((votes == BAD).any(axis=1), 0.1, 0.9) if len(votes) else np.empty(0)
    model, before = None, -math.inf
    for _ in range(EM_ROUNDS):
        by_class = np.stack([weights * (1 - share), weights * share])
        total = by_class.sum(axis=1)
        rates = (by_class @ fired + PRIOR / 2) / (total[:, None] + PRIOR)
        model = LabelModel(float((total[1] + PRIOR) / (total.sum() + 2 * PRIOR)), rates)
        share = model.posterior(votes)
        now = float((weights * share).sum() / max(1.0, weights.sum()))
        if abs(now - before) < EM_STOP:
            break
        before = now
    return model


def voted(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` with an array of votes, in the order of ``voters``."""
    text = F.coalesce("text", F.lit(""))
    measured = docs.withColumns(measures(text))
    return measured.select("doc_id", "text", F.array(*(v.cast("int") for v in voters().values())).alias("votes"))


def features(texts: pa.Array, bits: int = FEATURE_BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed features of each text: (text, feature, value) triples.

    Words by their hash, words by their last three bytes, and by their shape (which byte classes
    they hold); values are shares of the text's words, square-rooted.
    """
    raw, offsets = text_bytes(texts)
    starts, ends, begins = word_spans(raw, offsets, SPACED)
    text = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
    whole = word_hashes(raw, starts, ends, byte_values(lower=False))
    tails = word_hashes(raw, np.maximum(starts, ends - 3), ends, byte_values(lower=True, seed=1))
    kinds = np.zeros(256, dtype=np.uint8)
    for bit, (a, b) in enumerate(((97, 122), (65, 90), (48, 57), (33, 47), (58, 64), (91, 96), (123, 126), (128, 255))):
        kinds[a : b + 1] = 1 << bit
    shapes = np.bitwise_or.reduceat(kinds[raw], np.stack([starts, ends], 1).ravel()[:-1])[::2] if len(starts) else np.empty(0, np.uint8)
    shape = mixed(shapes.astype(np.uint64) + np.uint64(0x51ED))
    codes = np.concatenate([whole, tails, shape]) >> np.uint64(64 - bits)
    key, n = np.unique(np.tile(text.astype(np.int64), 3) << bits | codes.astype(np.int64), return_counts=True)
    rows = key >> bits
    return rows, key & ((1 << bits) - 1), np.sqrt(n / np.maximum(1, np.diff(begins))[rows])


@dataclass
class Scorer:
    weights: np.ndarray
    bias: float

    def score(self, texts: pa.Array) -> np.ndarray:
        rows, codes, values = features(texts)
        total = np.bincount(rows, weights=self.weights[codes] * values, minlength=len(texts)) + self.bias
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def hashed_rows(chosen: DataFrame) -> DataFrame:
    """(hash, votes, codes, shares): the features of each text of the sample, made where the texts are."""

    def step():  # noqa: ANN202
        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for part in slices(batch):
                rows, codes, values = features(part.column("text"))
                begins = pa.array(np.searchsorted(rows, np.arange(part.num_rows + 1)), pa.int32())
                yield pa.record_batch(
                    {
                        "hash": part.column("hash"),
                        "votes": part.column("votes"),
                        "codes": pa.ListArray.from_arrays(begins, pa.array(codes, pa.int32())),
                        "shares": pa.ListArray.from_arrays(begins, pa.array(values, pa.float32())),
                    }
                )

        return each

    return map_batches(chosen.select("hash", "text", "votes"), step, "hash long, votes array<int>, codes array<int>, shares array<float>")


def fit_scorer(code_lists: pa.ListArray, value_lists: pa.ListArray, labels: np.ndarray) -> Scorer:
    """Logistic regression on probabilities by Adagrad over small batches of a bounded sample."""
    codes, values = code_lists.flatten().to_numpy(), value_lists.flatten().to_numpy()
    begins = np.concatenate([[0], np.cumsum([len(x) for x in code_lists])]).astype(np.int64)
    weights, squares = np.zeros(1 << FEATURE_BITS), np.full(1 << FEATURE_BITS, 1e-8)
    bias, bias_square = 0.0, 1e-8
    rng = np.random.default_rng(SEED)
    for _ in range(EPOCHS):
        order = rng.permutation(len(labels))
        for some in np.array_split(order, max(1, len(order) // 256)):
            at = np.concatenate([np.arange(begins[i], begins[i + 1]) for i in some]) if len(some) else np.empty(0, int)
            row = np.repeat(np.arange(len(some)), begins[some + 1] - begins[some])
            total = np.bincount(row, weights=weights[codes[at]] * values[at], minlength=len(some)) + bias
            error = 1 / (1 + np.exp(-total)) - labels[some]
            slope = np.bincount(codes[at], weights=values[at] * error[row], minlength=len(weights)) / max(1, len(some)) + DECAY * weights
            squares += slope * slope
            weights -= RATE * slope / np.sqrt(squares)
            step = error.mean() if len(some) else 0.0
            bias_square += step * step
            bias -= RATE * step / math.sqrt(bias_square)
    return Scorer(weights, bias)


def sample_of(rows: DataFrame, total: int, fit_rows: int) -> pa.Table:
    """The features of the ``fit_rows`` different rows with the least hashes, in the order of these.

    A hash is within the bound with the share of rows wanted and six standard deviations, so what
    is written first is little more than the sample.
    """
    share = min(1.0, (fit_rows + 6 * math.sqrt(fit_rows) + 1) / max(1, total))
    bound = min(2**63 - 1, int((share - 0.5) * 2**64))  # xxhash64 is spread evenly over the longs
    scratch = Scratch(rows.sparkSession, "quality")
    hashed = rows.withColumn("hash", F.xxhash64(F.col("doc_id").cast("string"), "text"))
    near = scratch.spool(voted(hashed.filter(F.col("hash") <= F.lit(bound)).select("doc_id", "text")).withColumn(
        "hash", F.xxhash64(F.col("doc_id").cast("string"), "text")
    ))
    last = near.select("hash").distinct().orderBy("hash").limit(fit_rows).agg(F.max("hash")).first()[0]
    chosen = near.filter(F.col("hash") <= F.lit(last)).dropDuplicates(["hash"])
    out = hashed_rows(chosen).toArrow().sort_by("hash").combine_chunks()
    scratch.release()
    return out


def scored(docs: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> (doc_id, votes, label, score), one row per row.

    ``label`` is the posterior of the label model, ``score`` what the linear scorer gives, both the
    probability of good. ``fit_rows`` bounds the sample the scorer is fitted on, taken by hash of id and
    text, in which repeated rows count once; the label model counts all rows. Null text is empty: bad to
    all labellers that vote. Posteriors of one half are neither good nor bad to the scorer. Repeated rows
    and null ids are rows like others. Other columns are left out. Empty: empty.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    names = list(VOTERS)
    counts = voted(rows).groupBy("votes").agg(F.count("*").alias("n")).orderBy("votes").toArrow()
    patterns = np.array(counts["votes"].to_pylist(), dtype=np.int64).reshape(-1, len(names))
    model = fit_labels(patterns, counts["n"].to_numpy().astype(float))
    total = int(counts["n"].to_numpy().sum()) if counts.num_rows else 0
    sample = sample_of(rows, total, fit_rows)
    labels = model.posterior(np.array(sample["votes"].to_pylist(), dtype=np.int64).reshape(-1, len(names)))
    scorer = fit_scorer(sample["codes"].combine_chunks(), sample["shares"].combine_chunks(), labels)
    held = spark.sparkContext.broadcast((model, scorer))

    def step():  # noqa: ANN202
        model, scorer = held.value

        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for part in slices(batch):
                votes = np.array(part.column("votes").to_pylist(), dtype=np.int64).reshape(-1, len(names))
                yield pa.record_batch(
                    {
                        "doc_id": part.column("doc_id"),
                        "votes": part.column("votes"),
                        "label": pa.array(model.posterior(votes)),
                        "score": pa.array(scorer.score(part.column("text"))),
                    }
                )

        return each

    kind = dict(docs.dtypes)["doc_id"]
    return map_batches(voted(rows), step, f"doc_id {kind}, votes array<int>, label double, score double")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole text of documents; ``keep`` at a score of one half."""
    found = scored(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", "label", "score", (F.col("score") >= 0.5).alias("keep"), "votes")
