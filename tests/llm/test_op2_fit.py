"""The fit of the quality model: few bytes a feature beside the texts, and the weights of the plain formula."""

import random
import tracemalloc

import numpy as np

from lumenquery.llm import op2_quality as op2
from lumenquery.llm.common import word_hashes


def some_texts(n, size):
    rng = random.Random(3)
    return ["".join(rng.choice("abcdefghijklmnopqrst ") for _ in range(size)) for _ in range(n)]


def test_op2_fit_takes_few_bytes_a_feature():
    texts = some_texts(240, 12_000)
    bad = np.arange(len(texts)) % 2 == 0
    held = sum(len(op2.buckets(t, word_hashes(t, lower=False))[0]) for t in texts)
    tracemalloc.start()
    op2.fit(iter(texts), bad, 2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert held > 2_000_000 and peak < 12 * held, (peak, held)  # 24 bytes and more, when features were held opened


def test_op2_fit_equals_the_plain_formula(monkeypatch):
    monkeypatch.setattr(op2, "BLOCK", 700)  # a few texts each
    texts = ["", " ", *some_texts(20, 300), "a" * 5000, *some_texts(7, 40), ""]
    bad = np.random.default_rng(2).random(len(texts)) < 0.5
    x = np.zeros((len(texts), 1 << op2.BITS))
    for i, t in enumerate(texts):
        at, v = op2.features(t, word_hashes(t, lower=False))
        x[i, at] = v
    fitted, y = np.arange(len(texts)) % 3 != 2, bad.astype(float)
    use = fitted * np.where(bad, 0.5 / y[fitted].sum(), 0.5 / (1 - y)[fitted].sum())
    w, m, s = np.zeros((1 << op2.BITS) + 1), 0.0, 0.0
    for t in range(1, 31):
        g = (1 / (1 + np.exp(-(x @ w[:-1] + w[-1]))) - y) * use
        grad = np.append(x.T @ g + 1e-6 * w[:-1], g.sum())
        m, s = 0.9 * m + 0.1 * grad, 0.999 * s + 0.001 * grad**2
        w = w - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-9)
    got = op2.fit(texts, bad, 30)
    assert np.abs(got[0] - w[:-1]).max() < 1e-6
    assert np.allclose(got[1:], op2._platt((x @ w[:-1] + w[-1])[~fitted], y[~fitted], w[-1]), atol=1e-6)
