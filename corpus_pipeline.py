"""A corpus pipeline of five of the operators: each stage reads what the one before it has written.

Language ID drops texts without a language, the Jaccard join keeps one document of each group of near
duplicates, decontamination drops documents with benchmark passages, personal data is replaced in the
texts, and what is left is packed into sequences. All stages but the last return the columns of their
input, whatever they are called, and the rows they keep; rows with nulls in other columns pass.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomark.llm import decontaminate, jaccard_join, language_id, packing, pii
from foliomark.llm.bits import without
from foliomark.llm.tables import numbered, table
from foliomark.operators.spool import Scratch

TOKENIZER = "word_bpe_49k.json"


def _renamed(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """The table with its columns by position, apart from doc_id and text, so that no name can clash."""
    names = docs.columns
    return docs.toDF(*(n if n in ("doc_id", "text") else f"c{k}" for k, n in enumerate(names))), names


def _without(rows: DataFrame, gone: DataFrame, names: list[str], stage: str) -> DataFrame:
    """The rows but those numbered in ``gone``, in their old columns; texts that stay hardly travel."""
    gone = _copies[stage].spool(gone.select("row_id"))
    return without(rows, gone, "row_id").drop("row_id").toDF(*names)


#: what stages have written of their input, by stage
_copies: dict[str, Scratch] = {}


def _numbered(spark: SparkSession, rows: DataFrame, stage: str) -> DataFrame:
    """The rows with a number, written once.

    What earlier stages wrote this way goes: their results have been written and read again by now.
    """
    return _own(spark, stage).spool(numbered(rows))


def _own(spark: SparkSession, stage: str) -> Scratch:
    _release_before(stage)
    _copies[stage] = Scratch(spark, stage)
    return _copies[stage]


def _release_before(stage: str) -> None:
    names = [name for name, _ in STAGES]
    for name in names[: names.index(stage)]:
        if name in _copies:
            _copies.pop(name).release()


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: null texts and those without any letter. Learns from the input.

    Without labelled texts there is no language to tell and nothing is dropped but those.
    """
    rows, names = _renamed(docs)
    labels = F.col("lang") if "lang" in names else F.lit(None).cast("string")
    model = language_id.train(docs.filter(~language_id.held_out(F.col("doc_id"))).select("text", labels.alias("lang")))
    if not model.languages:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    found = language_id.identify(rows, model).filter(F.col("lang_pred") != language_id.UNDETERMINED)
    return found.select(rows.columns).toDF(*names)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of linked documents the one with the least doc_id; texts without words stay."""
    rows, names = _renamed(docs)
    rows = _numbered(spark, rows, "jaccard_join")
    groups = jaccard_join.joined(rows, "row_id")
    gone = groups.select("row_id").join(jaccard_join.first_of_each(groups), "row_id", "left_anti")
    return _without(rows, gone, names, "jaccard_join")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    rows, names = _renamed(docs)
    rows = _numbered(spark, rows, "decontamination")
    found = decontaminate.contained_items(rows, table(spark, sf_dir, "benchmark", "item_id", "text"), row_id="row_id")
    return _without(rows, found.filter("n_hit > 0"), names, "decontamination")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind in brackets; ``n_chars``, where there is one, follows the text."""
    rows, names = _renamed(docs)
    found = pii.with_spans(rows, scratch=_own(spark, "pii"))
    text = pii.redacted(F.col("text").cast("string"), F.col("spans"))
    # a column of its own first: inside lambdas, Spark takes a name for the new column of that name
    joined = found.withColumn("redacted", F.when(F.size("spans") > 0, text))
    columns = []
    for name, column in zip(names, rows.columns[: len(names)], strict=True):
        if column == "text":
            columns.append(F.coalesce("redacted", F.col("text").cast("string")).alias("text"))
        elif name == "n_chars":
            size = F.char_length("redacted").cast(dict(rows.dtypes)[column])
            columns.append(F.when(F.col("redacted").isNull(), F.col(column)).otherwise(size).alias(column))
        else:
            columns.append(F.col(column))
    return joined.select(columns).toDF(*names)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    import public_tokenizers

    _release_before("packing")
    return packing.packed(docs, public_tokenizers.path(TOKENIZER))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("jaccard_join", near_duplicates),
    ("decontamination", decontamination),
    ("pii", personal_data),
    ("packing", packed),
]

#: SQL has no byte pair encoding; the tests hold run() against a plain version instead
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read back."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for _, stage in STAGES:
        docs = scratch.spool(stage(spark, docs, sf_dir))
        if before is not None:
            scratch.drop(before)
        before = docs
    return docs
