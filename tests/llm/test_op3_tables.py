"""The language model's files: how much they take a token, and what their tables return."""

import os

import numpy as np

from lumenquery.llm import op3_kneser_ney as kn


def test_model_is_small(spark):
    rng = np.random.default_rng(5)
    words = np.array([f"w{i}" for i in range(50_000)])
    rows = [(d, " ".join(words[np.minimum(rng.zipf(1.2, 1000), 50_000) - 1])) for d in range(200)]
    manifest = kn.train(spark.createDataFrame(rows, "doc_id long, text string"), 3)
    model = kn.Model(manifest, int(spark.conf.get("spark.sql.shuffle.partitions")))
    assert model.n == 200 * 1001
    grams = sum(r[4] for r in manifest if r[0] in ("pair-2", "pair-3"))
    size = sum(os.path.getsize(r[2].removeprefix("file://")) for r in manifest)
    assert grams > 200_000
    assert size < 14 * grams, size / grams
    folder = os.path.dirname(manifest[0][2].removeprefix("file://"))
    assert sum(os.path.getsize(f"{folder}/{f}") for f in os.listdir(folder)) < 14 * grams


def opened(*args):
    return kn.Table(np.frombuffer(b"".join(kn.table(*args)), np.uint8))


def test_tables_return_what_went_in():
    rng = np.random.default_rng(6)
    for n in (0, 1, 31, 32, 5000):
        keys = np.unique(rng.integers(0, 1 << 64, 2 * n, np.uint64))[:n]
        c = rng.choice([1, 2, 254, 255, 256, 70_000, 5_000_000_000], len(keys))
        t = opened(keys[::-1], c[::-1], np.ones(len(keys), np.int64))
        asked = np.concatenate([keys, keys + np.uint64(1 << 50)])
        hit, at = t.find(asked)
        assert hit[: len(keys)].all() and not hit[len(keys) :].any()
        got, ones = t.counts(at)
        assert got.tolist() == c.tolist() and set(ones.tolist()) <= {1}


def test_keys_that_differ_in_their_last_bits_only():
    keys = np.array([5, 6, 1 << 40, (1 << 40) + 1, (1 << 64) - 1], np.uint64)
    t = opened(keys, np.arange(1, 6))
    hit, at = t.find(np.append(keys, np.uint64(7)))
    assert hit.tolist() == [True] * 5 + [False]
    assert next(t.counts(at)).tolist() == [1, 2, 3, 4, 5]


def test_blocks_keep_grams_and_counts():
    rng = np.random.default_rng(7)
    for order in (2, 3, 4):
        rows, counts = kn.distinct(rng.integers(0, kn.UNKNOWN, (3000, order)).astype(np.uint32) % rng.choice([3, 1 << 32], order).astype(np.uint64).astype(np.int64), rng.integers(1, 9, 3000))
        back = [kn.dealt(raw) for _, raw in kn.deal(rows.astype(np.uint32), counts, 7)]
        again, sums = kn.distinct(np.concatenate([g for g, _ in back]), np.concatenate([c for _, c in back]))
        assert (again == rows).all() and (sums == counts).all()
