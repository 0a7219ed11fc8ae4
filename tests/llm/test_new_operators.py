"""Operators 11 to 13 against brute force, on rows that are null, blank, long, equal, or oddly named too."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from lumenquery.llm import op11_embedding_dedup as op11
from lumenquery.llm import op12_collocations as op12
from lumenquery.llm import op13_periodic_runs as op13

DOCS = "doc_id long, text string, lang string, hash long, phrase string, n int"


def brute_links(rows, cosine):
    """vec_id: (n_links, component_id), by all pairs."""
    d = max([len(v or []) for _, v in rows])
    use = [i for i, (k, v) in enumerate(rows) if k is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    x = np.array([list(rows[i][1]) + [0.0] * (d - len(rows[i][1])) for i in use])
    x /= np.abs(x).max(1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    link = x @ x.T >= cosine
    np.fill_diagonal(link, False)
    ids = np.array([rows[i][0] for i in use])
    comp = ids.copy()
    while True:
        low = np.array([min([comp[i], *comp[link[i]]]) for i in range(len(comp))])
        if (low == comp).all():
            break
        comp = low
    out = Counter((rows[i][0], 0, rows[i][0]) for i in set(range(len(rows))) - set(use))
    return out + Counter((int(i), int(n), int(c)) for i, n, c in zip(ids, link.sum(1), comp, strict=True))


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (150, 12))
    near = np.repeat(x[:6], 25, axis=0) + rng.normal(0, 0.12, (150, 12))
    rows = [(i * 3, [float(v) for v in r]) for i, r in enumerate(np.concatenate([x, near]).astype(np.float32))]
    rows += [(5000 + i, rows[7][1]) for i in range(4)] + [(6000, [2 * v for v in rows[7][1]]), (6001, [1e30 * v for v in rows[7][1]]), (6002, [-v for v in rows[7][1]])]
    rows += [(7000, None), (7001, []), (7002, [0.0] * 12), (7003, [None] * 12), (7004, [float("nan")] * 12), (7005, [float("inf")] + [0.0] * 11), (None, rows[7][1])]
    return rows + [(8000, [1.0, 2.0]), (8001, [1.0, 2.0, 0.0]), (9, rows[40][1]), (9, rows[41][1])]


@pytest.mark.parametrize("cell, block, sample", [(1000, 1024, 65536), (20, 7, 65536), (30, 1000, 90)])
def test_op11_every_link(spark, vectors, cell, block, sample):
    """With the whole bound of visits every link is found, however rows fall into cells and blocks."""
    table = spark.createDataFrame([(k, v, "x", 1, 2) for k, v in vectors], "vec_id long, embedding array<float>, node string, cell int, e int")
    got = Counter((r.vec_id, r.n_links, r.component_id) for r in op11.dedup(table, 0.9, 1.0, cell, block, sample).collect())
    assert got == brute_links(vectors, 0.9)


def test_op11_default_recall_and_kept(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(0, 1, (1500, 64))
    near = np.repeat(x[:100], 15, axis=0) + rng.normal(0, 0.3, (1500, 64))  # cosines from 0.85 to 0.95
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(np.concatenate([x, near]))]
    want = {k: n for (k, n, _) in brute_links(rows, 0.9)}
    got = op11.dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sum(r.n_links for r in got) >= 0.97 * sum(want.values()) and all(r.n_links <= want[r.vec_id] for r in got)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_op11_empty(spark):
    assert op11.dedup(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    got = op11.dedup(spark.createDataFrame([(None, None), (3, None)], "vec_id long, embedding array<float>")).collect()
    assert sorted(map(str, map(tuple, got))) == ["(3, 0, 3, True)", "(None, 0, None, True)"]


def brute_phrases(docs, least, longest, nested, top):
    f, n = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    out = []
    cand = {c: a for c, a in f.items() if len(c[1]) > 1 and a >= least}
    inside = Counter()
    for (lang, w), a in cand.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                inside[lang, w[i : i + k]] = max(inside[lang, w[i : i + k]], a)
    for (lang, w), a in cand.items():
        score, _, l, r = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        if not 100 * inside[lang, w] >= nested * a:
            out.append((lang, score, a, " ".join(w), l, r))
    got = set()
    for lang in {x[0] for x in out}:
        own = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[1], -x[2], x[3].encode()))[:top]
        got |= {(lang, i, p, a, l, r, n[lang], s) for i, (_, s, a, p, l, r) in enumerate(own, 1)}
    return got


@pytest.fixture(scope="module")
def phrases(spark, sf):
    rows = [(r.text, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rng = random.Random(4)
    words = ["New", "york", "new", "YORK", "city", "of", "the", "é", "中文", "\x1c", "a-b", "Ünder", " x"]
    rows += [(rng.choice([" ", "\t", ", ", "\n"]).join(rng.choice(words) for _ in range(rng.randrange(60))), rng.choice(["en", None, "", "xx"])) for _ in range(200)]
    return rows + [(None, "en"), ("", None), (" .,; \n", "de"), ("new york city " * 5000, "en"), ("one two. three", "en")]


@pytest.mark.parametrize("least, longest, nested, top, bits", [(30, 4, 80, 2000, 27), (3, 4, 80, 50, 16), (2, 3, 50, 7, 8), (300, 2, 80, 9, 12)])
def test_op12_phrases(spark, phrases, least, longest, nested, top, bits):
    docs = spark.createDataFrame([(1, t, g, 1, "x", 1) for t, g in phrases], DOCS).repartition(3)
    got = [tuple(r) for r in op12.mine(docs, least, longest, nested, top, bits).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_phrases(phrases, least, longest, nested, top)


def test_op12_blocks_and_empty(spark, phrases, monkeypatch):
    monkeypatch.setattr(op12, "BLOCK", 50)
    docs = spark.createDataFrame([(1, t, g, 1, "x", 1) for t, g in phrases[-60:]], DOCS)
    assert {tuple(r) for r in op12.mine(docs, 5).collect()} == brute_phrases(phrases[-60:], 5, 4, 80, 2000)
    assert op12.mine(docs.limit(0)).count() == 0


def brute_runs(words, least, times):
    found = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, times * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((a, b - a, q) for (a, b), q in found.items())


@pytest.mark.parametrize("least, times", [(24, 3), (6, 3), (4, 2), (9, 4)])
def test_op13_runs_by_brute_force(least, times):
    rng = random.Random(9)
    for _ in range(250):
        n = rng.randrange(140)
        ids = [rng.randrange(rng.choice([1, 2, 3, 6])) for _ in range(n)]
        if n > 10:
            s, p = rng.randrange(n), rng.randint(1, 12)
            for i in range(s + p, min(n, s + p * rng.randint(2, 9))):
                ids[i] = ids[i - p]
        assert op13.runs(ids, least, times) == brute_runs(ids, least, times)


def test_op13_report(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows += [(None, "ab " * 30), (1_000_001, None), (1_000_002, " \n "), (1_000_003, "é 中 " * 40), (1_000_003, "é 中 " * 40), (1_000_004, "x " * 40_000), (1_000_005, "y\x1cz " * 24)]
    docs = spark.createDataFrame([(d, t, "en", 1, "x", 1) for d, t in rows], DOCS)
    got = Counter(tuple(r) for r in op13.report(docs).collect())
    want, rewritten = Counter(), 0
    for d, t in rows:
        w = re.findall("[^ \t-\r]+", t or "")
        h = zlib.crc32(str(d).encode())
        if d is not None and w and h % 10 == 0:
            a = h // 10 % len(w)
            p = 1 + (len(w) - a) // (3 + h // 10 % 8)
            w, rewritten = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))], rewritten + 1
        found = brute_runs(w, 24, 3) if len(w) < 5000 else [(0, len(w), 1)]
        best = sorted(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))[:1]
        gone = {i for a, n, p in found for i in range(a + p, a + n)}
        runs, kept = "".join("%d,%d,%d\n" % r for r in found), " ".join(x for i, x in enumerate(w) if i not in gone)
        want[(d, len(found), *(best[0] if best else (None,) * 3), 1000 * best[0][1] // best[0][2] if best else None, *(hashlib.sha256(x.encode()).hexdigest() for x in (runs, kept)))] += 1
    assert got == want and rewritten > 5 and sum(x[1] > 0 for x in want) > 5


def test_op13_detect_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b c " + "x y " * 12 + "z", "en", 1, "x", 1), (2, None, "en", 1, "x", 1)], DOCS)
    got = {r.doc_id: r for r in op13.detect(docs).collect()}
    assert [tuple(x) for x in got[1].runs] == [(3, 24, 2)] and got[1].collapsed == "a b c x y z" and got[2].runs == [] and got[2].collapsed == ""
    assert op13.report(docs.limit(0)).count() == 0 and op13.detect(docs.limit(0)).count() == 0


def test_op2_calibration_and_character_grams():
    from lumenquery.llm import op2_quality as op2

    rng = np.random.default_rng(1)
    z = rng.normal(0, 2, 4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-(1.7 * z - 0.6)))).astype(float)
    slope, intercept = op2._platt(z + 3.0, y, 3.0)  # the model's bias is in the scores, and comes back in the intercept
    assert abs(slope - 1.7) < 0.2
    p = 1 / (1 + np.exp(-(slope * z + intercept)))
    for low in np.arange(0, 1, 0.1):
        some = (p >= low) & (p < low + 0.1)
        assert some.sum() < 50 or abs(p[some].mean() - y[some].mean()) < 0.08
    # grams are of characters, whatever their bytes: as many for a text as for the same one in letters of two or three bytes
    latin, greek, han = "abcdefgh" * 3, "αβγδεζηθ" * 3, "甲乙丙丁戊己庚辛" * 3
    sizes = [len(op2.features(t, np.zeros(0, np.uint64))[0]) for t in (latin, greek, han)]
    assert sizes == [16, 16, 16]
    assert len(op2.features("abc", np.zeros(0, np.uint64))[0]) == 0
