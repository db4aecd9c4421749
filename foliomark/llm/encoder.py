"""Ids of texts by a public tokenizer, each distinct word encoded once and remembered.

Valid for tokenizers that drop white space before they cut (``word_bpe_49k.json``): no token crosses
a white space character, and none crosses from a letter of ``LETTERS`` to one of ``MARKS`` either, so the
ids of a text are those of its words. Case is folded beforehand only where that cannot change the
ids. What is remembered is bounded by ``limit`` words and dropped when full.

Words of letters alone are encoded many at a time, as a string costs more than its letters: each is one
unit to the tokenizer, so its ids end where a token with the suffix for the end of a word is.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from foliomark.llm.words import ragged, text_bytes

WORDS_LIMIT = 700_000
BATCH_WORDS = 20_000
#: words whose ids are looked up at once
RUN_WORDS = 1 << 18
#: words of letters that are encoded as one string
JOINED = 32
#: letters that stay one letter in lower case and composed form, whatever follows but a combining mark
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: marks that begin a unit after a letter; those of special strings and of shortened words are left out
MARKS = r"""!"#$%&()*+,\-./:;=?@\[\\\]^_`{}~"""
LETTERS_ALONE = re.compile(f"[{LETTERS}]+").fullmatch


def single_threaded() -> None:
    """Spark runs a worker for each core, so the library gets no threads of its own."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"


def load(path: str):  # noqa: ANN201 - the class is the library's
    single_threaded()
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class WordEncoder:
    def __init__(self, path: str, limit: int = WORDS_LIMIT) -> None:
        self.tokenizer, self.limit = load(path), limit
        self.last = self._last_tokens()
        self._clear()

    def _last_tokens(self) -> np.ndarray | None:
        """Which ids end a unit, where the tokenizer marks that by a suffix."""
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        if not suffix:
            return None
        vocabulary = self.tokenizer.get_vocab()
        out = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        out[[id_ for token, id_ in vocabulary.items() if token.endswith(suffix)]] = True
        return out

    def _clear(self) -> None:
        self.slots: dict[str, int] = {}
        self.starts = np.zeros(1 << 16, dtype=np.int64)
        self.lengths = np.zeros(1 << 16, dtype=np.int32)
        self.ids = np.zeros(1 << 18, dtype=np.uint32)
        self.used = 0

    def _add(self, words: list[str]) -> None:
        letters = [w for w in words if LETTERS_ALONE(w)] if self.last is not None else []
        others = [w for w in words if not LETTERS_ALONE(w)] if letters else words
        for kind, encoded in ((letters, self._together), (others, self._encoded)):
            for at in range(0, len(kind), BATCH_WORDS):
                some = kind[at : at + BATCH_WORDS]
                self._store(some, *encoded(some))

    def _encoded(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all strings, and the number of each string's."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)]
        lengths = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        return np.fromiter(chain.from_iterable(found), dtype=np.uint32, count=int(lengths.sum())), lengths

    def _together(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As ``_encoded`` for words of letters alone; if they are not one unit each, they go one by one."""
        flat, _ = self._encoded([" ".join(words[at : at + JOINED]) for at in range(0, len(words), JOINED)])
        stops = np.flatnonzero(self.last[flat]) + 1
        if len(stops) != len(words) or stops[-1] != len(flat):
            return self._encoded(words)
        return flat, np.diff(stops, prepend=0)

    def _store(self, words: list[str], flat: np.ndarray, lengths: np.ndarray) -> None:
        first, used = len(self.slots), self.used
        while first + len(words) > len(self.starts):
            self.starts, self.lengths = (np.concatenate([a, np.zeros_like(a)]) for a in (self.starts, self.lengths))
        while used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[used : used + len(flat)] = flat
        self.lengths[first : first + len(words)] = lengths
        self.starts[first : first + len(words)] = used + np.cumsum(lengths) - lengths
        self.used += len(flat)
        self.slots.update(zip(words, range(first, first + len(words)), strict=True))

    def words_of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The slot of each word, and the number of words before each text (one more at the end)."""
        raw, begins = text_bytes(texts)
        texts = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(begins), pa.py_buffer(raw))
        # neither the case of ASCII letters in a text without combining marks (from U+0300 on) nor white
        # space between a letter and a mark changes an id; both leave fewer distinct words
        plain = pc.invert(pc.match_substring_regex(texts, r"[^\x00-\x{2FF}]|<"))
        texts = pc.if_else(plain, pc.ascii_lower(texts), texts)
        texts = pc.replace_substring_regex(texts, pattern=f"([{LETTERS}])([{MARKS}])", replacement=r"\1 \2")
        lists = pc.ascii_split_whitespace(texts)
        del raw, plain, texts  # each is as large as the slice
        offsets = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
        words = lists.flatten().dictionary_encode()
        del lists
        distinct = words.dictionary.to_pylist()
        if len(self.slots) > self.limit:
            self._clear()
        slots = self.slots
        if new := [w for w in distinct if w not in slots]:
            self._add(new)
        at = np.fromiter(map(slots.__getitem__, distinct), dtype=np.int32, count=len(distinct))
        indices = words.indices.to_numpy(zero_copy_only=False)
        return (at[indices] if len(indices) else np.empty(0, np.int32)), offsets - offsets[0]

    def counts(self, texts: pa.Array) -> np.ndarray:
        """The number of ids of each text."""
        slots, offsets = self.words_of(texts)
        before = self._before(self.lengths[slots])
        return before[offsets[1:]] - before[offsets[:-1]]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and where each text's begin (one more at the end)."""
        slots, offsets = self.words_of(texts)
        lengths = self.lengths[slots]
        before = self._before(lengths)
        ids = np.empty(int(before[-1]), dtype=np.uint32)
        for at in range(0, len(slots), RUN_WORDS):
            some = slice(at, min(at + RUN_WORDS, len(slots)))
            ids[before[some.start] : before[some.stop]] = self.ids[ragged(self.starts[slots[some]], lengths[some])]
        return ids, before[offsets]

    @staticmethod
    def _before(lengths: np.ndarray) -> np.ndarray:
        """The sum of the lengths before each word, and of all."""
        out = np.zeros(len(lengths) + 1, dtype=np.int64)
        np.cumsum(lengths, out=out[1:])
        return out
