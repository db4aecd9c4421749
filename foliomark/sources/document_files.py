"""Documents and their images as files, with a commit.

A write has two steps. Tasks stage every file in a folder of their own attempt and list what they
staged; nothing is visible yet, and the commit messages that reach the driver name attempts only. The
driver's commit writes down which attempts count. Then tasks move the staged files to their names
and the listings become the manifest. A write that fails before the commit leaves nothing behind; one
that dies after it is finished by calling ``publish`` again, as every move can be repeated. Attempts
that were lost or ran twice are never named, so their files vanish with the staging folder. (Object
stores have no folders: there, a task that outlives an abort may leave staged files, never others;
the next write to that manifest removes them.)

Texts and images of a document come from the same row, so the parser behind them runs once and no copy
of the texts is made on the way.
"""

from __future__ import annotations

import io
import json
import random
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from foliomark.functions.images import image_folder, image_name
from foliomark.operators.spool import Scratch, remove
from foliomark.sources.files import parent
from foliomark.sources.sinks import mark_superseded
from foliomark.sources.stores import Stores, exists, qualified

FORMAT = "document_files"
IMAGES = "array<struct<out_path:string,page_no:int,img_no:int,content:binary>>"
ROWS = f"path string, out_path string, text string, error string, images {IMAGES}"
MANIFEST = "kind string, out_path string, path string, status string, error string"
STAGED = pa.schema([(c, pa.string()) for c in ("kind", "out_path", "path", "error", "document", "staged")])
_COMMITTED = "committed.json"
# Files that a folder of an attempt gets at most: large folders are slow.
FOLDER_FILES = 256
# Staging folders that stay after an export, see ``staging_kept``.
_KEPT: set[str] = set()


@dataclass
class Staged(WriterCommitMessage):
    """The attempt of a task whose files count, and how many there are."""

    attempt: str
    files: int


class DocumentFiles(DataSource):
    """``write.format("document_files")`` of rows ``ROWS``; option ``staging`` names the folder to stage in."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return ROWS

    def writer(self, schema: StructType, overwrite: bool) -> DocumentWriter:
        return DocumentWriter(self.options["staging"], self.options.get("spare"))


class DocumentWriter(DataSourceArrowWriter):
    """Stages files in tasks; the commit names the attempts that count, an abort removes everything.

    Folders in ``spare`` hold files that nobody needs any more: a task takes one over and writes into its files.
    """

    def __init__(self, staging: str, spare: str | None = None) -> None:
        self.staging, self.spare = staging, spare

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        stores, attempt = Stores(), uuid.uuid4().hex
        folders: list[str] = []
        rows: list[tuple] = []
        spare = [path for path, _, _, is_folder in stores.entries(self.spare) if is_folder] if self.spare else []
        random.shuffle(spare)  # so that tasks seldom reach for the same one

        def new_folder(name: str) -> str:
            # Folders are made one level at a time: after an abort there is none to write to any more.
            stores.make(f"{self.staging}/{name}", parents=False)
            folders.append(f"{self.staging}/{name}")
            return folders[-1]

        def places() -> Iterator[str]:
            while True:
                name = f"{attempt}-{len(folders)}"
                if not spare:
                    made = new_folder(name)
                    yield from (f"{made}/{k}" for k in range(FOLDER_FILES))
                elif stores.shift(spare.pop(), f"{self.staging}/{name}"):
                    folders.append(f"{self.staging}/{name}")
                    yield from [path for path, _, _, is_folder in stores.entries(folders[-1]) if not is_folder]

        free = places()

        def stage(kind: str, out_path: str, path: str, content: bytes | None, error: str | None, document: str) -> None:
            staged = None
            if error is None:
                staged = next(free)
                stores.put(staged, content)  # no one looks for it before its attempt is listed
            rows.append((kind, out_path, path, error, document, staged))

        folder = new_folder(attempt)
        try:
            for batch in iterator:
                for r in batch.to_pylist():
                    text = None if r["text"] is None else r["text"].encode()
                    error = r["error"] or (None if text is not None else "no text")
                    stage("text", r["out_path"], r["path"], text, error, r["path"])
                    for i in r["images"] or () if error is None else ():
                        lacking = "no content" if i["content"] is None else None
                        stage("image", i["out_path"], f"{r['path']}#{i['page_no']}.{i['img_no']}", i["content"], lacking, r["path"])
            listed = io.BytesIO()
            pq.write_table(pa.table([pa.array([r[k] for r in rows], pa.string()) for k in range(len(STAGED))], schema=STAGED), listed)
            stores.write(f"{folder}/staged.parquet", listed.getvalue(), make=False)
        except BaseException:
            for made in folders:
                stores.clear(made)
            raise
        return Staged(attempt, sum(r[5] is not None for r in rows))

    def commit(self, messages: list[Staged | None]) -> None:
        counted = [m.attempt for m in messages if m is not None]
        Stores().write(f"{self.staging}/{_COMMITTED}", json.dumps(counted).encode())

    def abort(self, messages: list[Staged | None]) -> None:
        Stores().clear(self.staging)


def document_images(pages: Column, out_path: Column, stem: Column, image_dir: str = "images") -> Column:
    """The images of all pages with the files they belong in: where the text's links lead."""
    folder = F.concat(parent(out_path), image_folder(image_dir, stem), F.lit("/"))
    each = F.transform(
        pages,
        lambda p: F.transform(
            F.coalesce(p["images"], F.array().cast("array<struct<img_no:int,content:binary>>")),
            lambda i: F.struct(
                F.concat(folder, image_name(p["page_no"], i["img_no"])).alias("out_path"),
                p["page_no"].alias("page_no"), i["img_no"].alias("img_no"), i["content"].alias("content"),
            ),
        ),
    )
    return F.flatten(each).cast(IMAGES)


def _staging(spark: SparkSession, manifest_folder: str) -> str:
    return f"{qualified(spark, manifest_folder)}.staging"


@contextmanager
def staging_kept(spark: SparkSession, manifest_folder: str) -> Iterator[None]:
    """Exports inside follow each other, and each is read and withdrawn before the next; all name this manifest.

    Where files were deleted just now, some disks (ext4 without a journal) look at each of them for every file
    they make, and for every folder. So the next export writes into the files of a withdrawn one and uses its folders.
    """
    staging = _staging(spark, manifest_folder)
    _KEPT.add(staging)
    try:
        yield
    finally:
        _KEPT.discard(staging)
        remove(spark, staging)
        remove(spark, _spare(staging))
        remove(spark, _empties(staging))


def withdraw(spark: SparkSession, rows: DataFrame, manifest_folder: str) -> None:
    """Take away the files of an export, given the ``rows`` of its manifest; images go with their whole folders.

    Inside ``staging_kept`` the next export gets them to write into. Each goes there by one rename, so a task that
    runs twice never hands on a file under two names.
    """
    spare = _spare(_staging(spark, manifest_folder))
    Stores().make(spare)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stores = Stores()
        for batch in batches:
            found = list(zip(batch.column("kind").to_pylist(), batch.column("out_path").to_pylist(), strict=True))
            for folder in {parent_of(path) for kind, path in found if kind == "image"}:
                if not stores.shift(folder, f"{spare}/{uuid.uuid4().hex}"):
                    stores.clear(folder)
            texts = f"{spare}/{uuid.uuid4().hex}"
            stores.make(texts)
            for k, path in enumerate({path for kind, path in found if kind == "text"}):
                if not stores.shift(path, f"{texts}/{k}"):
                    stores.discard(path)
            yield batch

    def parent_of(path: str) -> str:
        return path.rpartition("/")[0]

    written = rows.where("status = 'written'").select("kind", "out_path")
    written.mapInArrow(run, "kind string, out_path string").count()


def _spare(staging: str) -> str:
    return f"{staging}.spare"


def _empties(staging: str) -> str:
    return f"{staging}.empties"


def _clear(spark: SparkSession, staging: str, attempts: list[str] | None = None) -> None:
    """Remove a staging folder; inside ``staging_kept`` the emptied folders of ``attempts`` wait to become others."""
    stores = Stores()
    if staging in _KEPT and attempts:
        for attempt in attempts:
            stores.clear(f"{staging}/{attempt}")  # the listing, large beside empty folders
        stores.make(_empties(staging))
        if stores.shift(staging, f"{_empties(staging)}/{uuid.uuid4().hex}"):
            return
    remove(spark, staging)


def export_documents(docs: DataFrame, manifest_folder: str) -> DataFrame:
    """Write ``docs(path, out_path, text)`` with optional ``error`` and ``images`` as files; returns the manifest.

    The manifest has a row for every text and image: ``kind, out_path, path, status, error``, status
    written, failed or superseded (another document's file has that name; see ``precedence``). A
    failed document has no images. All files must lie in one store with the manifest folder, beside
    which they are staged. Texts are null only with an error.
    """
    spark = docs.sparkSession
    staging = _staging(spark, manifest_folder)
    remove(spark, staging)  # what an earlier write that died left, if it was not committed
    nothing = F.lit(None)
    rows = docs.select(
        F.col("path").cast("string").alias("path"), "out_path", "text",
        (F.col("error") if "error" in docs.columns else nothing).cast("string").alias("error"),
        (F.col("images") if "images" in docs.columns else nothing).cast(IMAGES).alias("images"),
    )
    Stores().make(staging)
    spark.dataSource.register(DocumentFiles)
    place = {"staging": staging} | ({"spare": _spare(staging)} if staging in _KEPT else {})
    rows.write.format(FORMAT).mode("append").options(**place).save()
    return publish(spark, manifest_folder)


def committed(spark: SparkSession, manifest_folder: str) -> bool:
    """Whether a write has been committed and waits to be published."""
    return exists(spark, f"{_staging(spark, manifest_folder)}/{_COMMITTED}")


def publish(spark: SparkSession, manifest_folder: str) -> DataFrame:
    """Move the files of a committed write to their names and write the manifest; may be repeated."""
    staging = _staging(spark, manifest_folder)
    if not committed(spark, manifest_folder):
        if exists(spark, f"{manifest_folder}/_SUCCESS"):
            return spark.read.schema(MANIFEST).parquet(manifest_folder)
        raise RuntimeError(f"nothing is committed for {manifest_folder}")
    attempts = json.loads(Stores().read(f"{staging}/{_COMMITTED}"))
    listed = spark.createDataFrame([], ", ".join(f"{c} string" for c in STAGED.names))
    if attempts:
        listed = spark.read.schema(listed.schema).parquet(*(f"{staging}/{a}/staged.parquet" for a in attempts))
    scratch = Scratch(spark, "publish")
    # of several files with one name one is moved; narrow rows, no texts
    marked = scratch.spool(mark_superseded(listed.where("kind = 'text'")))
    losers = marked.where("superseded").select(F.col("path").alias("document")).distinct().withColumn("lost", F.lit(True))
    images = listed.where("kind = 'image'").join(losers, "document", "left")
    images = images.select(*STAGED.names, F.col("lost").isNotNull().alias("superseded"))

    empties = _empties(staging) if staging in _KEPT else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stores = Stores()
        for old, *_ in stores.entries(empties) if empties else ():
            stores.empties += [path for path, _, _, is_folder in stores.entries(old) if is_folder]
        random.shuffle(stores.empties)
        for batch in batches:
            done = []
            for r in batch.itertuples(index=False):
                status, error = "written", None
                if not pd.isna(r.error):
                    status, error = "failed", r.error
                elif r.superseded:
                    status = "superseded"
                else:
                    try:
                        stores.move_once(r.staged, r.out_path)
                    except Exception as failure:  # noqa: BLE001 - a failed move is a manifest row
                        status, error = "failed", f"{type(failure).__name__}: {failure}"
                done.append((r.kind, r.out_path, r.path, status, error))
            yield pd.DataFrame(done, columns=["kind", "out_path", "path", "status", "error"])

    moved = marked.select(*STAGED.names, "superseded").unionByName(images).mapInPandas(run, MANIFEST)
    moved.write.mode("overwrite").parquet(manifest_folder)
    scratch.release()
    _clear(spark, staging, attempts)
    return spark.read.schema(MANIFEST).parquet(manifest_folder)
