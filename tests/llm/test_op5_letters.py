"""op5's words of a-z alone go past the tokenizer's rules, with the same ids."""

import random

import numpy as np

from lumenquery.llm import op5_token_ids as op5


class Counted:
    def __init__(self, inner):
        self.inner, self.calls = inner, 0

    def __getattr__(self, name):
        self.calls += 1
        return getattr(self.inner, name)


def test_op5_letters_alone():
    own, rng = op5.Encoder(op5.tokenizer_path()), random.Random(4)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzTHEW", k=rng.randint(1, 25))) for _ in range(5000)] + ["s", "t", "re", "ll", "d", "dont", "THE", "x" * 3000]
    texts = [" ".join(rng.choices(words, k=80)) for _ in range(300)] + ["", "one\n\ttwo  three"]
    want = [[*own.tokenizer.encode(t, add_special_tokens=False).ids, op5.END] for t in texts]
    own.tokenizer = Counted(own.tokenizer)
    for _ in range(2):  # new words, then known ones
        assert all(np.array_equal(a, b) for a, b in zip(own.encode(texts), want, strict=True))
    assert own.tokenizer.calls == 0


def test_op5_known_words_next_to_new_ones():
    own = op5.Encoder(op5.tokenizer_path())
    own.encode(["known words, only"])
    texts = ["known new words, again", own.special[0] + " known other", "new", "Ärger known łódź. x1"]
    want = [[*own.tokenizer.encode(t, add_special_tokens=False).ids, op5.END] for t in texts]
    assert all(np.array_equal(a, b) for a, b in zip(own.encode(texts), want, strict=True))
