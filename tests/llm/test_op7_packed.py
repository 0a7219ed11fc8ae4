"""Units' paths by packed longs: those of the plain loop, and of the fold over structs where scores don't fit."""

import random

from lumenquery.llm import op7_sentencepiece as op7

from .test_op7_lattice import best_path


def test_op7_packed_paths(spark, monkeypatch):
    rng = random.Random(8)
    units = {"\u2581", "x" * 256, "=" * 255, "\u2581" * 40, "\u1234" * 9, "\u2581the", *("".join(rng.choices(chars, k=rng.randrange(1, 40))) for chars in ("etaoins", "ab=", "\u2581abc", "\u7684\u4e00\u1234") for _ in range(60))}
    rows = spark.createDataFrame([(u,) for u in units], "unit string")
    pieces, scores, _, usable = op7.vocabulary(op7.model_path())
    table, low = op7.piece_table(spark, op7.model_path()), float(min(s for s, u in zip(scores, usable, strict=True) if u) - 10)
    assert op7.packs(table, low) and not op7.packs(table.withColumn("score", table.score - 0.5), low)
    want = {u: best_path(u) for u in units}
    assert {r.unit: list(r.ids) for r in op7.viterbi(rows, table, low).collect()} == want
    monkeypatch.setattr(op7, "packs", lambda *a: False)
    assert {r.unit: list(r.ids) for r in op7.viterbi(rows, table, low).collect()} == want
