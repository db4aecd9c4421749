"""Sinks: the corpus table, one file per document, and the manifest."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliomark.functions.images import image_folder, image_name
from foliomark.operators.spool import Scratch
from foliomark.sources.files import parent
from foliomark.sources.stores import Stores

# Ways a group of documents with one output path is split, so that no task gets all of it.
SPLITS = 64

MANIFEST = "out_path string, path string, status string, error string"


def precedence(path: Column) -> Column:
    """Order in which inputs claim a path: ``.PDF`` after ``.pdf``, then by name; the last one stays."""
    return F.struct(F.endswith(path, F.lit(".PDF")).alias("upper"), path.alias("path"))


def path_collisions(docs: DataFrame) -> DataFrame:
    """``out_path, n, kept`` of the output paths claimed more than once; ``kept`` survives an export."""
    claims = docs.groupBy("out_path").agg(
        F.count(F.lit(1)).alias("n"), F.max(precedence(F.col("path")))["path"].alias("kept")
    )
    return claims.where(F.col("n") > 1)


def mark_superseded(docs: DataFrame) -> DataFrame:
    """Add ``superseded``: another document with the same output path is kept instead.

    Failed documents (``error``) neither win nor lose a path. The claims on a path are reduced
    per hash split first and then over at most ``SPLITS`` rows. What is joined back are the losers'
    paths alone, so the texts stay where they are unless the losers are too many to broadcast.
    Reads ``docs`` twice.
    """
    alive = F.col("error").isNull() if "error" in docs.columns else F.lit(True)
    split = F.pmod(F.xxhash64("path"), F.lit(SPLITS)).alias("_split")
    keys = docs.where(alive).select("out_path", "path", split)
    claims = keys.groupBy("out_path", "_split").agg(F.count(F.lit(1)).alias("n"), F.max(precedence(F.col("path"))).alias("top"))
    over = W.partitionBy("out_path")
    contested = (
        claims.withColumn("total", F.sum("n").over(over))
        .withColumn("_kept", F.max("top").over(over)["path"])
        .where(F.col("total") > 1)
        .select("out_path", "_split", "_kept")
    )
    lost = keys.join(contested, ["out_path", "_split"]).where(F.col("path") != F.col("_kept"))
    losers = lost.select("out_path", "path").distinct().withColumn("_lost", F.lit(True))
    marked = docs.join(losers, ["out_path", "path"], "left")
    return marked.select(*docs.columns, (alive & F.col("_lost").isNotNull()).alias("superseded"))


def write_corpus(docs: DataFrame, folder: str) -> dict[str, int]:
    """The corpus as a table, the form to use at scale; returns how many documents were written and failed.

    The counts are observed while the rows pass by, so nothing is read or parsed a second time.
    """
    failed = F.col("error").isNotNull() if "error" in docs.columns else F.lit(False)
    seen = Observation()
    counts = {"written": F.count(F.when(~failed, 1)), "failed": F.count(F.when(failed, 1))}
    docs.observe(seen, *[c.alias(name) for name, c in counts.items()]).write.mode("overwrite").parquet(folder)
    return {name: int(seen.get[name]) for name in counts}


def export_markdown(docs: DataFrame, manifest_folder: str) -> DataFrame:
    """Write one UTF-8 file per document to its ``out_path``; returns the manifest.

    Takes ``docs(path, out_path, text)`` with an optional ``error``: failed documents are
    listed, not written. Works on every file system pyarrow can open. A file appears under its
    name only when complete, so a repeated task leaves no torn file; two documents never write
    to the same path. The texts are written as a table first, so that the parser behind them
    runs once; that table is removed in the end. Give it a stored corpus to spare the copy's work.
    """
    error = F.col("error") if "error" in docs.columns else F.lit(None).cast("string")
    texts = docs.select("path", "out_path", F.col("text").cast("binary").alias("content"), error.alias("error"))
    return _export(texts, manifest_folder)


def export_images(docs: DataFrame, manifest_folder: str, image_dir: str = "images") -> DataFrame:
    """Write the images of ``docs(path, out_path, stem, pages)`` beside their Markdown; returns the manifest.

    An image lies where the text's link leads: ``image_dir/<stem>/page_p_img_i.png`` below the
    folder of ``out_path``. An image without content is a failed row and keeps its number.
    """
    folder = F.concat(parent(F.col("out_path")), image_folder(image_dir, F.col("stem")), F.lit("/"))
    pages = docs.where(F.col("pages").isNotNull()).select("path", folder.alias("folder"), F.explode("pages").alias("p"))
    images = pages.select("path", "folder", F.col("p.page_no").alias("page_no"), F.explode("p.images").alias("i"))
    rows = images.select(
        F.concat("path", F.lit("#"), F.col("page_no").cast("string"), F.lit("."), F.col("i.img_no").cast("string")).alias("path"),
        F.concat("folder", image_name(F.col("page_no"), F.col("i.img_no"))).alias("out_path"),
        F.col("i.content").alias("content"),
        F.when(F.col("i.content").isNull(), F.lit("no content")).alias("error"),
    )
    return _export(rows, manifest_folder)


def _export(rows: DataFrame, manifest_folder: str) -> DataFrame:
    """Files of ``rows(path, out_path, content, error)`` and their manifest."""
    scratch = Scratch(rows.sparkSession, "export")
    stored = scratch.spool(rows)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stores = Stores()
        for batch in batches:
            done = []
            for r in batch.itertuples(index=False):
                if not pd.isna(r.error):
                    done.append((r.out_path, r.path, "failed", r.error))
                elif r.superseded:
                    done.append((r.out_path, r.path, "superseded", None))
                else:
                    try:
                        stores.write(r.out_path, bytes(r.content))
                        done.append((r.out_path, r.path, "written", None))
                    except Exception as failure:  # noqa: BLE001 - a failed write is a manifest row
                        done.append((r.out_path, r.path, "failed", f"{type(failure).__name__}: {failure}"))
            yield pd.DataFrame(done, columns=["out_path", "path", "status", "error"])

    mark_superseded(stored).mapInPandas(run, MANIFEST).write.mode("overwrite").parquet(manifest_folder)
    scratch.drop(stored)
    return rows.sparkSession.read.parquet(manifest_folder)


def manifest(docs: DataFrame) -> DataFrame:
    """``out_path, status, error`` of a converted corpus, ordered by path.

    A plan only. A sort samples its input first, so give it a stored corpus (``write_corpus``) where a
    parser is behind the rows.
    """
    status = F.when(F.col("error").isNotNull(), "failed").otherwise("written")
    return docs.select("out_path", status.alias("status"), "error").orderBy("out_path")


def manifest_counts(listing: DataFrame) -> DataFrame:
    return listing.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
