"""claim_match's containment: texts move once, their grams don't, whatever the parts that left sets come in."""

import random

import pytest
from pyspark.sql import functions as F

from lumenquery.operators import similarity as J
from lumenquery.plans import evidence_queries


@pytest.mark.parametrize("part, counted", [(500_000, 1_000_000), (20, 50)])
def test_contained_in_parts(spark, monkeypatch, part, counted):
    monkeypatch.setattr(J, "PART", part)
    monkeypatch.setattr(J, "COUNTED", counted)
    rng = random.Random(5)
    left = [(i, [rng.choice("abcdefgh") for _ in range(rng.randrange(7))]) for i in range(40)]
    right = [(i, "".join(rng.choices("abcdefghxyz", k=rng.randrange(9)))) for i in range(40)] + [(None, "abcdefgh")]
    r = J.dealt(spark.createDataFrame(right, "k int, text string"), ["k"], 1600)
    got = {(x.id, x.k): x.score for x in J.contained(spark.createDataFrame(left, "id int, a array<string>"), "id", "a", r.select("k", F.split("text", "").alias("b")), ["k"], "b", 0.34).collect()}
    assert got == {(i, k): len(set(a) & set(t)) / len(set(a)) for i, a in left for k, t in right if a and len(set(a) & set(t)) / len(set(a)) >= 0.34}


def test_claim_match_moves_texts_once(spark, sf):
    """One exchange, and what it moves are texts: grams and pairs would be many times their size."""
    df = evidence_queries.claim_match(spark, sf)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    moved = [x for x in plan.splitlines() if "Exchange" in x and "Broadcast" not in x]
    assert len(moved) == 1 and "REPARTITION_BY_NUM" in moved[0]
