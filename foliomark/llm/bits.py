"""A set of 64-bit hashes as a table of bits of fixed size, small enough for every task.

It only spares work: whatever it lets through by chance is compared exactly later, so results do not
depend on its size.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 26
PROBES = 4
#: bits in one value of Spark's bitmap functions
BUCKET = 8 * 4096


def bit_table(hashes: DataFrame, column: str, bits: int = BITS) -> Broadcast:
    """The bits of all values of a long column, at most ``2**bits / 8`` bytes (8 MB) for any input."""
    # the upper bits of a hash choose a word of 64 bits, the lowest ones four of its bits
    h = F.col(column)
    mask = reduce(lambda x, y: x.bitwiseOR(y), (_bit(F.shiftrightunsigned(h, 6 * k)) for k in range(PROBES)))
    words = hashes.select(F.shiftrightunsigned(h, 64 - (bits - 6)).cast("int").alias("w"), mask.alias("b"))
    words = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    table = np.zeros(1 << (bits - 6), dtype=np.uint64)
    table[words["w"].to_numpy()] = words["b"].to_numpy().view(np.uint64)
    return hashes.sparkSession.sparkContext.broadcast(table)


def _bit(h: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))


def contains(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the uint64 hashes may be in the table."""
    one, low = np.uint64(1), np.uint64(63)
    mask = np.zeros(len(hashes), dtype=np.uint64)
    for k in range(PROBES):
        mask |= one << ((hashes >> np.uint64(6 * k)) & low)
    return table[hashes >> np.uint64(64 - (len(table).bit_length() - 1))] & mask == mask


def parted(rows: DataFrame, ids: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The rows whose ``key`` may be in ``ids``, and those whose key is not. DataFrame functions only.

    ``ids`` and ``rows`` should be written tables: both are read twice. What all tasks get are at most
    ``2**BITS / BUCKET + 1`` bitmaps (8 MB) for any number of ids; with many ids for its size, the table
    lets more rows through, up to all of them. So only few rows need to travel to be joined exactly.
    """

    def slot() -> Column:
        return F.pmod(F.xxhash64(key), F.lit(1 << BITS))

    maps = ids.select(F.bitmap_bucket_number(slot()).alias("_bucket"), F.bitmap_bit_position(slot()).alias("_bit"))
    maps = maps.groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    asked = rows.withColumns({"_bucket": F.bitmap_bucket_number(slot()), "_bit": F.bitmap_bit_position(slot())})
    asked = asked.join(F.broadcast(maps), "_bucket", "left")
    byte = F.conv(F.hex(F.substr("_bits", F.floor(F.col("_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    may = F.col("_bits").isNotNull() & (byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), (F.col("_bit") % 8).cast("int"))) != 0)
    return asked.filter(may).select(rows.columns), asked.filter(~may).select(rows.columns)


def without(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose ``key`` is not in ``ids(key)``; only those that the bits let through are shuffled."""
    may, clear = parted(rows, ids, key)
    return clear.union(may.join(ids, key, "left_anti").select(rows.columns))
