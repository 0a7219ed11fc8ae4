"""Posting lists of op8 that are met in rounds: only a part of them at once, and no link is lost."""

import random

from lumenquery.llm import op8_jaccard


def test_lists_in_rounds(spark, monkeypatch):
    rng = random.Random(3)
    rows = []
    for g in range(40):
        words = [f"w{rng.randrange(4000)}" for _ in range(60)]
        for c in range(3):  # copies that differ in places of their own
            own = list(words)
            own[rng.randrange(20) + 20 * c] = f"x{g}-{c}"
            rows.append((3 * g + c, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: set(zip(*(t.split()[j:] for j in range(5)))) for i, t in rows}
    want = {i: min(j for j in sets if 100 * len(sets[i] & sets[j]) >= 60 * len(sets[i] | sets[j])) for i in sets}
    assert want == {i: i - i % 3 for i in sets}
    lists, write = [], op8_jaccard.materialize

    def counted(df, label):
        out = write(df, label)
        if label == "listsx":
            lists.append(out.selectExpr("coalesce(sum(size(mx)), 0) AS n").first().n)
        return out

    monkeypatch.setattr(op8_jaccard, "materialize", counted)
    monkeypatch.setattr(op8_jaccard, "first_links", lambda members: members.select(members.fp.alias("a"), members.fp.alias("b")).limit(0))
    monkeypatch.setattr(op8_jaccard, "ROUND_ROWS", 10)
    got = {r.doc_id: r.component_id for r in op8_jaccard.join(docs, 5, 60, count=False).collect()}
    assert got == want
    assert len(lists) == op8_jaccard.ROUNDS and sum(lists) > 100 and max(lists) < 0.6 * sum(lists)
