"""Rows out of arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unnest(
    df: DataFrame, keep: list, array: Column, value: str, ordinal: str | None = None
) -> DataFrame:
    """One row per element of a computed array, with a 0-based ordinal when named.

    A plain explode makes the optimizer add a filter on the array's size, pushed down to the
    scan, where the whole array is computed a second time. The outer form is left alone; the
    row it makes of an empty array is removed afterwards.
    """
    made = (
        F.posexplode_outer(array).alias(ordinal, value) if ordinal
        else F.explode_outer(array).alias(value)
    )
    return df.select(*keep, made).where(F.col(ordinal or value).isNotNull())
