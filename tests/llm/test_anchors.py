"""Windows that travel are found by anchors: all that repeat are among them, and hardly any that do not."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from foliomark.llm import substring
from foliomark.llm.words import byte_values


def windows_of(*texts: str, window: int = 35, gram: int = 8) -> substring.Windows:
    return substring.Windows(pa.array(texts), window, gram, byte_values(lower=False))


def repeated(windows: substring.Windows) -> np.ndarray:
    hashes = windows.anchors()
    values, n = np.unique(hashes, return_counts=True)
    return np.isin(hashes, values[n > 1])


def test_words_shared_by_chance_travel_nowhere():
    """Ten common words hold common minimisers, but no window repeats."""
    a, b = ([f"{x}{k}" for k in range(200)] for x in "ab")
    shared = [f"c{k}" for k in range(10)]
    texts = (" ".join(a[:k] + shared + a[k:] + b[:k] + shared + b[k:]) for k in range(30, 60))
    for text in texts:
        windows = windows_of(text)
        assert not len(windows.super_kmers(repeated(windows))[0])


def test_every_repeated_window_travels():
    rng = random.Random(3)
    for window, gram in ((35, 8), (12, 4), (5, 2), (4, 4), (6, 5)):
        for size in (2, 5, 50):
            texts = [" ".join(rng.choice("abcdefghijklmnopqrstuvwxyz"[:size]) for _ in range(rng.randint(0, 90))) for _ in range(20)]
            texts += [f"{texts[0]} x {texts[1]}", f"y {texts[0]}", " ".join("z" * 70), " ".join("pq" * 40)]
            windows = windows_of(*texts, window=window, gram=gram)
            row, start, length, _ = windows.super_kmers(repeated(windows))
            sent = {(r, s + k) for r, s, n in zip(row.tolist(), start.tolist(), length.tolist(), strict=True) for k in range(n)}
            places: dict[tuple, list] = {}
            for i, text in enumerate(texts):
                words = text.split()
                for k in range(len(words) - window + 1):
                    places.setdefault(tuple(words[k : k + window]), []).append((i, k))
            assert sent >= {p for some in places.values() if len(some) > 1 for p in some}
