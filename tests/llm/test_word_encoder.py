"""Words of letters are encoded many at a time, and the ids are those of the library."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pyarrow as pa

from foliomark.llm import encoder as module
from foliomark.llm.encoder import WordEncoder

PATH = public_tokenizers.path("word_bpe_49k.json")


class Counting:
    """A tokenizer that counts the strings it is given."""

    def __init__(self, tokenizer):
        self.tokenizer, self.strings = tokenizer, 0

    def encode_batch_fast(self, strings, **options):
        self.strings += len(strings)
        return self.tokenizer.encode_batch_fast(strings, **options)


def assert_is_the_library(encoder: WordEncoder, texts: list[str]) -> None:
    ids, begins = encoder.encode(pa.array(texts))
    whole = module.load(PATH).encode_batch(texts, add_special_tokens=False)
    for text, a, b, e in zip(texts, begins, begins[1:], whole, strict=False):
        assert ids[a:b].tolist() == e.ids, text


def test_words_of_letters_go_together():
    rng = random.Random(7)
    words = sorted({"".join(rng.choices("abcdefghijklmnopqrstuvwxyzßéñü", k=rng.randint(3, 12))) for _ in range(5000)})
    ends = ["", "***", "$$$", "!", ",", ".)", "..."]
    texts = [" ".join(w.capitalize() * (k % 2) or w for k, w in enumerate(words)), " ".join(w + rng.choice(ends) for w in words)]
    encoder = WordEncoder(PATH)
    encoder.tokenizer = counting = Counting(encoder.tokenizer)
    assert_is_the_library(encoder, texts)
    # capitals beyond ASCII make words of their own, marks and other capitals do not
    assert counting.strings < len(words) / 10, (counting.strings, len(words))


def test_hard_characters():
    rng = random.Random(8)
    some = [*"abTKZéÉñßÿŸ×÷ªµİıΣςσ", *"'’.,$*|<>=-_@#^`~", *"0٣½1", "́", "̈", "̸", "̇", "̊", "日", "𝒳", " ", "\t", " ", " ", " ",
            "<|endoftext|>", "<|startoftext|>", "'s", "'LL", "endoftext|>", "K", "ǆ", "ẞ"]
    texts = ["".join(rng.choices(some, k=rng.randint(0, 40))) for _ in range(6000)]
    for joined in (1, 32):
        module.JOINED, before = joined, module.JOINED
        try:
            assert_is_the_library(WordEncoder(PATH), texts)
        finally:
            module.JOINED = before


def test_words_that_are_more_than_a_unit_go_alone():
    encoder = WordEncoder(PATH)
    encoder.last = np.ones_like(encoder.last)  # as if every token ended a unit
    assert_is_the_library(encoder, ["internationalisation of unusualwordings"])
