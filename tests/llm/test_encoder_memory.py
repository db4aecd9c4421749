"""The encoder's memory stays near that of its slice."""

from __future__ import annotations

import tracemalloc

import public_tokenizers
import pyarrow as pa

from foliomark.llm.encoder import WordEncoder


def test_memory_of_the_encoder():
    """Ids of a slice take a few times its own memory, not one array after the other of eight bytes a word."""
    encoder = WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    text = pa.array(["the cat sat on a mat so it is " * 20_000] * 10)  # 6 MB, 1.8 million words
    encoder.encode(text.slice(0, 1))
    tracemalloc.start()
    ids, begins = encoder.encode(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    alone, _ = encoder.encode(text.slice(0, 1))
    assert all((ids[a:b] == alone).all() and b - a == len(alone) for a, b in zip(begins, begins[1:]))
    assert peak < 28 * 1_800_000, peak / 1_800_000
