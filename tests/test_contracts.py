"""Contracts as data against rows that break them; greedy cover, contexts and packets against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from lumenquery.operators import answers as A
from lumenquery.operators import contracts as K
from lumenquery.operators import windows as W

SCHEMA = "id int, name string, tags array<string>, base array<string>, parts array<struct<k:int,kind:string,inner:struct<x:double>,notes:array<string>>>, extra int"
CONTRACT = {
    "type": "struct",
    "fields": {
        "id": {"type": "value", "required": True, "least": 1, "most": 9},
        "name": {"type": "value", "required": True, "blank": False, "pattern": "^[a-z ]*$", "enum": ["ann", "bob", " "]},
        "tags": {"type": "array", "required": True, "least": 1, "most": 3, "unique": True},
        "base": {"type": "array"},
        "gone": {"type": "value"},
        "parts": {"type": "array", "unique": "k", "items": {"type": "struct", "required": True, "fields": {"k": {"type": "value", "required": True}, "kind": {"type": "value", "enum": ["a", "b"]}, "inner": {"type": "struct", "required": True, "fields": {"x": {"type": "value", "least": 0.0}}}, "notes": {"type": "array", "items": {"type": "value", "required": True}}}}},
    },
    "subset": [("tags", "base")],
    "disjoint": [("base", "tags")],
}
ALWAYS = {("gone", "absent"), ("extra", "unknown")}


def rows(spark, *r):
    return spark.createDataFrame(list(r), SCHEMA)


def test_violations_have_paths(spark):
    fine = (1, "ann", ["t"], ["t"], [(1, "a", (0.5,), ["n"]), (2, None, (None,), None)], 0)
    bad = (0, "X1", ["t", "u", "t", None], ["v"], [(1, "c", (-1.0,), [None, "n"]), (1, "a", None, []), None, (None, "b", (1.0,), None)], None)
    empty = (None, None, None, None, None, None)
    blank = (10, " ", [], ["z"], [], 1)
    got = {}
    for r in K.violations(rows(spark, fine, bad, empty, blank), ["id"], CONTRACT).collect():
        got.setdefault(r.id, set()).add((r.path, r.code))
    assert got[1] == ALWAYS | {("base", "overlaps_tags")}
    assert got[0] == ALWAYS | {
        ("id", "too_small"), ("name", "pattern"), ("name", "not_in_enum"), ("tags", "too_many"), ("tags[2]", "repeated"), ("tags", "not_within_base"), ("parts[1].k", "repeated"), ("parts[0].kind", "not_in_enum"), ("parts[0].inner.x", "too_small"),
        ("parts[0].notes[0]", "missing"), ("parts[1].inner", "missing"), ("parts[2]", "missing"), ("parts[3].k", "missing"),
    }
    assert got[None] == ALWAYS | {("id", "missing"), ("name", "missing"), ("tags", "missing")}
    assert got[10] == ALWAYS | {("id", "too_large"), ("name", "blank"), ("tags", "too_few")}


def test_types_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, "a", None), (3, None, 2), (4, None, 3)], "id int, name string, n int")
    contract = {"type": "struct", "fields": {"id": {"type": "array"}, "name": {"type": "struct", "fields": {}}, "n": {"type": "value"}}}
    got = {(r.id, r.path, r.code) for r in K.violations(df, ["id"], contract, [["name"], ["id"]]).collect()}
    assert got == {(i, p, "type") for i in (1, 2, 3, 4) for p in ("id", "name")} | {(i, "name", "repeated_row") for i in (1, 2, 3, 4)}
    assert K.violations(df.limit(0), ["id"], contract).count() == 0


def test_diversify_picks_as_a_plain_loop(spark):
    rng = random.Random(1)
    data = [(rng.choice(["x", "y", None]), i, [rng.choice("abcdefg") for _ in range(rng.randrange(4))], rng.randrange(4)) for i in range(120)] + [("z", 500, None, 1), ("z", 501, [], 1)]
    got = {(r.unit, r["pick"], r.item) for r in W.diversify(spark.createDataFrame(data, "unit string, item int, concepts array<string>, score int"), "unit", 6).collect()}
    want = set()
    for unit in {d[0] for d in data}:
        left, seen = [d for d in data if d[0] == unit], set()
        for n in range(1, 7):
            if left:
                best = min(left, key=lambda d: (-len(set(d[2] or []) - seen), -d[3], d[1]))
                left.remove(best)
                seen |= set(best[2] or [])
                want.add((unit, n, best[1]))
    assert got == want


@pytest.fixture(scope="module")
def context(spark):
    q = spark.createDataFrame([(1, "The red fox ran. Blue whales sing songs! The red fox ran"), (2, "nothing here"), (3, "")], "question int, text string")
    found = spark.createDataFrame([(1, 1, 11, 9), (1, 2, 12, 8), (1, 3, 13, 7), (1, 4, 14, 6), (2, 1, 11, 5)], "question int, rank int, doc_id int, score int")
    docs = spark.createDataFrame([(11, "see: the red fox ran away " * 30, 0), (12, "x", 1), (13, "blue whales sing on and on", 0), (14, "y", 0)], "doc_id int, text string, toxic int")
    selected, rejected = A.select(found, docs, F.when(F.col("toxic") == 1, "toxic"), 2)
    return q, selected, rejected, A.claims(q, selected)


def test_context(context):
    _, selected, rejected, claims = context
    assert {(r.question, r.label, r.doc_id) for r in selected.collect()} == {(1, "V1", 11), (1, "V2", 13), (2, "V1", 11)}
    assert {(r.question, r.doc_id, r.reason) for r in rejected.collect()} == {(1, 12, "toxic"), (1, 14, "beyond_limit")}
    got = {(r.question, r.claim_id): (r.text, r.status, r.ceiling, r.labels, r.weak_labels) for r in claims.collect()}
    assert got == {(1, "C1"): ("The red fox ran", "supported", "medium", ["V1"], []), (1, "C2"): ("Blue whales sing songs", "conditional", "low", [], ["V2"]), (2, "C1"): ("nothing here", "unresolved", "none", [], [])}
    assert {r.question: r.supported for r in A.supports_scope(claims, F.col("text").contains("fox")).collect()} == {1: True, 2: False}


def test_packets(spark, context):
    made = A.contexts(*context).cache()
    packets = made.select("question", A.packet(F.col("context")).alias("packet")).cache()
    assert {r.question: r.problem for r in A.checked(packets, made).collect()} == {1: None, 2: None, 3: None}
    first = packets.where("question = 1").first().packet
    assert first.evidence[0].excerpt.endswith("…") and len(first.evidence[0].excerpt) == A.EXCERPT
    worse = packets.withColumn("packet", F.when(F.col("question") == 1, F.col("packet").withField("query", F.lit("?"))).when(F.col("question") == 2, F.col("packet").withField("digest", F.lit("0"))).otherwise(F.col("packet")))
    other = worse.union(packets.where("question = 3").withColumn("question", F.lit(9)))
    assert {r.question: r.problem for r in A.checked(other, made).collect()} == {1: "projection", 2: "digest", 3: None, 9: "no_context"}
