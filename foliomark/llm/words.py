"""Words of many texts at once: numpy over the bytes of an Arrow string column.

The functions run inside tasks, on slices of a batch, so their memory is bounded by the slice (or by
one text, if that is larger). Words are runs of bytes of a class; as every class here holds all bytes
of non-ASCII characters or none, bytes of UTF-8 give the same words as characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20
HASH_BYTES = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``limit`` bytes of text; a larger text is a run alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes.astype(np.int64))
    row, total = 0, len(sizes)
    while row < total:
        before = int(ends[row - 1]) if row else 0
        stop = max(row + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(row, stop - row)
        row = stop


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in one array, and where each begins; null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    first, last = (int(offsets[0]), int(offsets[-1])) if len(offsets) else (0, 0)
    return raw[first:last], offsets - first


def word_spans(raw: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the number of words before each text (one more at the end)."""
    flags = inside[raw]
    before = np.empty(len(raw), dtype=bool)
    before[:1] = False
    before[1:] = flags[:-1]
    cuts = offsets[:-1][offsets[:-1] < len(raw)]
    before[cuts] = False
    starts = np.flatnonzero(flags & ~before)
    after = np.empty(len(raw), dtype=bool)
    after[-1:] = False
    after[:-1] = flags[1:]
    cuts = offsets[1:][offsets[1:] > 0] - 1
    after[cuts] = False
    ends = np.flatnonzero(flags & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        powers = np.full(n, base, dtype=np.uint64)
        powers[0] = 1
        out.append(np.multiply.accumulate(powers))
    return out[0], out[1]


def byte_values(lower: bool, seed: int = 0) -> np.ndarray:
    """A random 64-bit value for each byte; with ``lower``, A-Z have those of a-z."""
    values = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03) + np.uint64(seed))
    if lower:
        values[65:91] = values[97:123]
    return values


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each word."""
    out = np.empty(len(starts), dtype=np.uint64)
    row = 0
    while row < len(starts):
        first = int(starts[row])
        stop = max(row + 1, int(np.searchsorted(ends, first + HASH_BYTES, side="right")))
        last = int(ends[stop - 1])
        size = last - first
        power, inverse = _powers(max(HASH_BYTES, size) + 1)
        sums = np.zeros(size + 1, dtype=np.uint64)
        np.cumsum(values[raw[first:last]] * power[:size], out=sums[1:])
        a, b = starts[row:stop] - first, ends[row:stop] - first
        out[row:stop] = (sums[b] - sums[a]) * inverse[a] + (b - a).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
        row = stop
    return mixed(out)


def run_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each ``size`` consecutive words; the caller leaves out runs that cross texts."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    factor = _BASE
    for k in range(size):
        total += words[k : k + n] * np.uint64(factor)
        factor = (factor * _BASE + 2) % (1 << 64) | 1
    return mixed(total)


def bytes_outside(*ranges: tuple[int, int]) -> np.ndarray:
    """The class of all bytes except those in the ranges, ends included."""
    inside = np.ones(256, dtype=bool)
    for a, b in ranges:
        inside[a : b + 1] = False
    return inside


#: ``[^\x20\x09-\x0D]+`` and ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` (after lower-casing A-Z)
SPACED = bytes_outside((0x20, 0x20), (0x09, 0x0D))
ALNUM = bytes_outside((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))


def lowered(raw: np.ndarray) -> np.ndarray:
    """The bytes with A-Z lower-cased."""
    return np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of each run, run after run."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
