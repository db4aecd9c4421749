"""Running values over ordered rows of one key, however many rows the key has.

A key is cut into runs of positions. Each run is scanned by itself and gives one summary; the summaries
of a key, one row per run, are scanned in turn, and what lies before a run goes back to its rows. So no
task ever holds or sorts more than a run of rows or the summaries of a key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Positions of one run.
SPAN = 1 << 16


@dataclass(frozen=True)
class Running:
    """One running value of the rows before (or, with ``after``, behind) each row, itself excluded.

    ``how`` is ``sum`` (null counts as 0, nothing gives 0) or ``last``: the nearest value that is not null.
    """

    name: str
    value: Column
    how: str = "last"
    after: bool = False


def run_of(position: str, span: int) -> Column:
    return F.floor(F.col(position) / F.lit(span)).cast("long")


def running(df: DataFrame, key: str, order: list[str], values: list[Running], span: int = SPAN, run: str | None = None) -> DataFrame:
    """Add running values in the order of ``order``; its first column is the position that is cut into runs.

    Positions are whole numbers from 0, ``order`` is unique in a key, keys are not null. The rows are
    read twice: give a stored table. ``run`` names a column that has the runs (``run_of``) already: rows
    go to their run once, however many calls with it follow each other.
    """
    at = run or "_run"
    numbered = df if run else df.withColumn(at, run_of(order[0], span))
    named = numbered.select("*", *[v.value.alias(f"_v{k}") for k, v in enumerate(values)])
    place = F.struct(*order)

    def total(k: int, v: Running) -> Column:
        if v.how == "sum":
            return F.sum(f"_v{k}").alias(f"_t{k}")
        near = F.when(F.col(f"_v{k}").isNotNull(), F.struct(place.alias("at"), F.col(f"_v{k}").alias("v")))
        # the place decides, so the nearest value of a run is its greatest or least place
        return (F.min(near) if v.after else F.max(near))["v"].alias(f"_t{k}")

    def over(k: int, v: Running, window) -> Column:  # noqa: ANN001
        rows = window.rowsBetween(Window.unboundedPreceding, -1)
        if v.how == "sum":
            return F.coalesce(F.sum(k).over(rows), F.lit(0))
        return F.last(k, ignorenulls=True).over(rows)

    def ordered(by: list[str], columns: list[str], after: bool):  # noqa: ANN202
        return Window.partitionBy(*by).orderBy(*[F.desc(c) if after else F.asc(c) for c in columns])

    totals = named.groupBy(key, at).agg(*[total(k, v) for k, v in enumerate(values)])
    carried = totals.select(
        key, at, *[over(f"_t{k}", v, ordered([key], [at], v.after)).alias(f"_c{k}") for k, v in enumerate(values)]
    )
    local = named.select("*", *[over(f"_v{k}", v, ordered([key, at], order, v.after)).alias(f"_l{k}") for k, v in enumerate(values)])
    joined = local.join(carried, [key, at])

    def whole(k: int, v: Running) -> Column:
        here, before = F.col(f"_l{k}"), F.col(f"_c{k}")
        return (here + before if v.how == "sum" else F.coalesce(here, before)).alias(v.name)

    return joined.select(*df.columns, *[whole(k, v) for k, v in enumerate(values)])
