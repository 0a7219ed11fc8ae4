"""Retrieval metrics by hand, and floors in each direction."""

import math

import pytest

from lumenquery.operators import suites as S


def test_cases_by_hand(spark):
    found = spark.createDataFrame([(1, 1, 10), (1, 2, 11), (1, 3, 12), (2, 1, 20), (2, 2, 21), (3, 1, 30)], "question int, rank int, doc_id int")
    gold = spark.createDataFrame([(1, 11, 2), (1, 13, 1), (2, 20, 1), (4, 40, 1)], "question int, doc_id int, gain int")
    known = spark.createDataFrame([(10, True), (12, False), (21, True)], "doc_id int, bad boolean")
    got = {r.question: r for r in S.cases(found, gold, known, 3).collect()}
    assert set(got) == {1, 2, 4}
    one = got[1]
    assert (one.expected, one.hits, one.recall, one.rr, one.primary, one.bad) == (2, 1, 0.5, 0.5, False, 1)
    assert one.ndcg == pytest.approx((2 / math.log2(3)) / (2 + 1 / math.log2(3))) and one.known_precision == pytest.approx(1 / 3)
    assert (got[2].rr, got[2].ndcg, got[2].known_precision, got[2].primary, got[2].bad) == (1.0, 1.0, 0.5, True, 1)
    assert (got[4].hits, got[4].recall, got[4].rr, got[4].ndcg, got[4].known_precision, got[4].primary) == (0, 0.0, 0.0, 0.0, None, False)
    values = {r.metric: r.value for r in S.metrics(S.cases(found, gold, known, 3), "s").collect()}
    assert values["cases"] == 3 and values["violations"] == 2 and values["recall"] == 0.5 and values["primary_top_k"] == pytest.approx(0.3333)


def test_floors(spark):
    values = spark.createDataFrame([("s", m, v) for m, v in (("up", 0.89), ("up2", 0.8), ("down", 3.0), ("same", 1.0), ("new", 1.0))], "suite string, metric string, value double")
    floors = spark.createDataFrame([("s", "up", 0.9, "higher", 0.01), ("s", "up2", 0.9, "higher", 0.05), ("s", "down", 2.0, "lower", None), ("s", "same", 1.05, "equal", 0.05), ("s", "gone", 1.0, "higher", 0.0)], "suite string, metric string, floor double, direction string, tolerance double")
    assert {r.metric: r.status for r in S.compared(values, floors).collect()} == {"up": "ok", "up2": "regressed", "down": "regressed", "same": "ok", "new": "new", "gone": "missing"}
