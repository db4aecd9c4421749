"""Session settings the engine expects, for local runs and as a reference for clusters."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(app: str = "foliomark", cores: str | int = "*", checkpoints: str | None = None) -> SparkSession:
    """A local session for tests and benchmarks. On a cluster use its own session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Small inputs use all cores too; large ones have splits enough of their own.
        .config("spark.sql.files.minPartitionNum", "8")
        .config("spark.sql.files.openCostInBytes", "64k")
        .config("spark.driver.memory", os.environ.get("FOLIOMARK_DRIVER_MEMORY", "8g"))
        # Call sites are captured per expression; the text steps are thousands of them.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if checkpoints:
        builder = builder.config("spark.checkpoint.dir", checkpoints)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
