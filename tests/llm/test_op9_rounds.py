"""Rounds of op9's index: as few as prove something, and the same rows as brute force."""

import numpy as np
import pytest

from lumenquery.llm import op9_topk


def brute(x, ids, queries, query_ids, k):
    out = []
    for q, own in zip(queries, query_ids, strict=True):
        found = sorted((-int(a.astype(np.int64) @ q.astype(np.int64)), int(i)) for a, i in zip(x, ids, strict=True) if i != own)
        out += [(int(own), i, -s) for s, i in found[:k]]
    return out


@pytest.mark.parametrize("kind", ["even", "skewed", "ties"])
def test_rounds(monkeypatch, kind):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 24)) * (256 if kind == "even" else 3)
    if kind == "skewed":
        x[:, 0] = rng.integers(0, 300, 300) * 1000
    x, ids = np.floor(x), rng.permutation(300)
    made, read, bincount = [], [], np.bincount
    monkeypatch.setattr(op9_topk.Index, "__init__", lambda self, v, f=op9_topk.Index.__init__: made.append(len(v)) or f(self, v))
    monkeypatch.setattr(op9_topk.np, "bincount", lambda rows, *a, **b: read.append(len(rows)) or bincount(rows, *a, **b))
    got = op9_topk.top_of_block(x, ids, x[:20], ids[:20], 5, 256)
    assert got == brute(x, ids, x[:20], ids[:20], 5)
    assert made == [300]  # a block of somewhat more rows than others isn't parted
    assert len(read) <= 2 * 20  # nothing proved by the first round: the last is next
    if kind == "skewed":
        assert sum(read) < 0.5 * 20 * x.size
