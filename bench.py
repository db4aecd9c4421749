"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import functions as F  # noqa: E402

from foliomark.operators import documents  # noqa: E402
from foliomark.operators.spool import spool  # noqa: E402
from foliomark.session import local_session  # noqa: E402
from foliomark.workload import views  # noqa: E402
from foliomark.workload.queries import QUERIES  # noqa: E402

HEADLINE = (
    "cleanup", "classify_lines", "chunk_documents", "format_text", "picture_tables", "drop_consecutive",
    "compress_levels", "repair_separator", "running_headers", "removed_headers", "assemble_doc",
    "assemble_arrays", "strip_headers_footers", "strip_page_table", "attach_images",
    "fallback_to_original", "convert_pages", "superseded_outputs",
)
REPEATS = 3
FILES = 16


def in_many_files(spark, sf_dir: str) -> str:
    """The tables with the documents in several files: the given one is a single row group, so one task's work."""
    folder = tempfile.mkdtemp(prefix="bench-")
    for table in Path(sf_dir).glob("*.parquet"):
        if table.name != "documents.parquet":
            os.symlink(table, f"{folder}/{table.name}")
    spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(FILES).write.parquet(f"{folder}/documents.parquet")
    return folder


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    tables = in_many_files(spark, sf_dir)
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    n_docs = docs.count()

    def run(name: str) -> float:
        started = time.perf_counter()
        QUERIES[name](spark, tables).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - started

    # The operator alone, on texts written beforehand.
    noisy = spool(views.noisy_docs(spark, tables), "bench")

    def cleanup_alone() -> float:
        started = time.perf_counter()
        documents.cleanup(noisy).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - started

    # Best of several rounds: in the first one every query pays for compilation.
    rounds = [{name: run(name) for name in HEADLINE} for _ in range(REPEATS)]
    seconds = {name: round(min(r[name] for r in rounds), 3) for name in HEADLINE}
    alone = round(min(cleanup_alone() for _ in range(REPEATS)), 3)
    chars = noisy.agg(F.sum(F.char_length("text"))).first()[0]
    print(
        json.dumps(
            {
                "metric": "sum of best query times",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"),
                "documents": n_docs,
                "tasks": {"documents": docs.rdd.getNumPartitions(), "cleanup": documents.cleanup(noisy).rdd.getNumPartitions()},
                "cleanup_alone": {"seconds": alone, "chars": chars},
                "docs_per_sec": {
                    name: round(n_docs / seconds[name]) for name in ("cleanup", "classify_lines", "chunk_documents")
                },
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
