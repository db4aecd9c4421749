"""Steps over texts get batches bounded in bytes, not only in rows."""

from __future__ import annotations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliomark.llm import decontaminate, packing
from foliomark.operators.spool import ARROW_BYTES, Scratch

MB = 1 << 20


@pytest.fixture
def texts(spark, tmp_path):
    """24 texts of half a MB in one partition."""
    path = str(tmp_path / "texts")
    rows = spark.range(0, 24, 1, 1).select(F.col("id").alias("doc_id"), F.expr(f"repeat('ab c', {MB // 8})").alias("text"))
    rows.write.parquet(path)
    return spark.read.parquet(path).coalesce(1)


def measured(texts):  # noqa: ANN001, ANN201
    """Pieces that hold the size of their batch."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            one = pa.array([1] * batch.num_rows, pa.int64())
            size = pa.array([batch.column("text").nbytes] * batch.num_rows, pa.int64())
            yield pa.record_batch([batch.column("doc_id"), one, one, size, one], names=names)

    return texts.mapInArrow(run, f"doc_id long, {packing.PIECE}")


def test_packing_gets_small_batches(spark, texts):
    found = packing.pack(measured(texts))
    assert found.count() == 24
    assert found.agg(F.max("ids_crc32")).first()[0] <= 5 * MB
    assert ARROW_BYTES not in spark.conf.getAll


def test_decontamination_asks_for_small_batches(spark, texts, monkeypatch):
    limits, spool = [], Scratch.spool

    def spooled(self, df, partitions=None, batch_bytes=None):  # noqa: ANN001, ANN202
        if "runs" in df.columns:
            limits.append(batch_bytes)
        return spool(self, df, partitions, batch_bytes)

    monkeypatch.setattr(Scratch, "spool", spooled)
    items = spark.createDataFrame([("i", "ab cab cab")], "item_id string, text string")
    assert decontaminate.contained_items(texts, items).count() == 24
    assert limits == [4 * MB]


@pytest.mark.parametrize("own", [None, str(64 * MB)])
def test_a_size_of_the_session_stays(spark, texts, own):
    if own:
        spark.conf.set(ARROW_BYTES, own)
    try:
        found = Scratch(spark, "sizes").spool(measured(texts), batch_bytes=4 * MB)
        assert (found.agg(F.max("ids_crc32")).first()[0] <= 5 * MB) == (own is None)
        assert spark.conf.getAll.get(ARROW_BYTES) == own
    finally:
        spark.conf.unset(ARROW_BYTES)


def test_a_failed_step_leaves_the_session_as_it_was(spark, texts):
    with pytest.raises(Exception, match="no such text"):
        Scratch(spark, "sizes").spool(texts.select(F.raise_error(F.lit("no such text"))), batch_bytes=4 * MB)
    assert ARROW_BYTES not in spark.conf.getAll
