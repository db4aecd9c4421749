"""Expressions built once per application."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def built(spark: SparkSession, step: Callable[[Column], Column], column: str) -> Column:
    """``step`` applied to the named column.

    A long expression is thousands of calls into the driver's JVM, so it is built once and
    used again: it names its column and is bound to no table.
    """
    named = getattr(step, "__qualname__", "<")
    if "<" in named:  # lambdas, local functions and partials are new at each call
        return step(F.col(column))
    return _built(step, column, spark.sparkContext.applicationId)


@lru_cache(maxsize=64)
def _built(step: Callable[[Column], Column], column: str, application: str) -> Column:
    return step(F.col(column))
