"""op7's lattice against a plain loop: units of any length in stretches, and pieces that reach over the edge of letters."""

import random

from lumenquery.llm import op7_sentencepiece as op7


def best_path(text):
    """The best path of a whole text, which nothing has cut into units."""
    pieces, scores, of_byte, usable = op7.vocabulary(op7.model_path())
    ids = {p: i for i, p in enumerate(pieces) if usable[i]}
    low, longest = min(scores[i] for i in ids.values()) - 10, max(map(len, ids))
    best = [(0.0, 0, None)]
    for e in range(1, len(text) + 1):
        top = None
        for s in range(max(0, e - longest), e):
            i = ids.get(text[s:e])
            if (i is not None or e == s + 1) and (top is None or best[s][0] + (low if i is None else scores[i]) > top[0]):
                top = best[s][0] + (low if i is None else scores[i]), s, i
        best.append(top)
    out, e = [], len(text)
    while e:
        _, s, i = best[e]
        out.append((-1,) if i is None else (i,))
        e = s
    return [i for x in reversed(out) for i in x]


def samples():
    rng = random.Random(5)
    every = lambda chars, n: "".join(rng.choices(chars, k=n))
    return [
        "x" * 81, "=" * 1000, "▁" * 700, every("abcdefghijklmnopqrstuvwxyz", 3000), every("的一是不了人我在有他这中大来上", 600), "-" * 33 + "=" * 700, "ሴ" * 300,
        "internationalization" * 40, *(every("etaoins", n) for n in (255, 256, 257, 271, 272, 273, 511, 512, 513, 528)), *(every("ab=", n) for n in (1, 15, 16, 17, 33)),
    ]


def test_op7_stretches_are_exact(spark):
    units = spark.createDataFrame([(u,) for u in samples()], "unit string").distinct()
    pieces, scores, _, usable = op7.vocabulary(op7.model_path())
    low, longest = min(s for s, u in zip(scores, usable, strict=True) if u) - 10, max(len(p) for p, u in zip(pieces, usable, strict=True) if u)
    want = {u: best_path(u) for u in samples()}
    for stretch in (longest, 50, 256):
        got = {r.unit: list(r.ids) for r in op7.viterbi_of_long(units, op7.piece_table(spark, op7.model_path()), float(low), longest, stretch).collect()}
        assert got == want


def test_op7_whole_text_is_the_lattice(spark):
    long = samples()[3]
    texts = ["5 km². All", "²", "².", "x².y ². ..²..", f"a {long} b {long}", "²" + "." * 300 + "²." * 200, None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert long in {r.unit.strip("▁") for r in op7.distinct_units(docs, op7.model_path()).collect()}
    encoded = op7.encode(docs)
    for r in encoded.collect():
        assert r.ids == (best_path("▁" + texts[r.doc_id].replace(" ", "▁")) if texts[r.doc_id] else []) and r.round_trip
    assert {r.doc_id: r.text for r in op7.decode(encoded).collect()} == {i: t or "" for i, t in enumerate(texts)}
    assert all(op7.units_of(t) == ["▁" + t] for t in ("².", "²"))
