"""Operators on small inputs: rules, numerals, shards, global places, sinks that are replayed, late rows, vectors without a length."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lumenquery.functions import text as T
from lumenquery.operators import matching as M
from lumenquery.operators import questions as Q
from lumenquery.operators import records as X
from lumenquery.operators import retrieval as R
from lumenquery.operators import windows as W
from lumenquery.sources import sinks, stored, tables
from lumenquery.streaming import events as S


def one(spark, c, text):
    return spark.createDataFrame([(text,)], "t string").select(c).first()[0]


def test_shards_of_ideographs(spark):
    got = one(spark, Q.shards(F.col("t"), ["怎么"], "一-鿿"), "A1 怎么打高远球 ok x")
    assert {"a1", "ok", "高远球", "打高", "么打高远"} <= set(got) and "怎么" not in got and "x" not in got and "怎么打高远球" in got


@pytest.mark.parametrize("text,minutes,source", [("练半小时", 30, "half_hour"), ("45分钟", 45, "digits"), ("二十五分钟", 25, "numeral"), ("十分钟", 10, "numeral"), ("八分钟", 8, "numeral")])
def test_minutes(spark, text, minutes, source):
    got = spark.createDataFrame([(text,)], "t string").select(*[c.alias(n) for n, c in Q.session_minutes(F.col("t")).items()]).first()
    assert (got.minutes, got.source) == (minutes, source)


def test_places_of_overlapping_occurrences(spark):
    assert one(spark, Q.positions(F.col("t"), "aba"), "ababa xaba") == [0, 2, 7]
    assert one(spark, Q.positions(F.col("t"), "ab"), "xyz") == []


def test_longer_match_of_another_value_shadows(spark):
    rules = [("side", "front", "hand"), ("side", "back", "backhand"), ("side", "front", "fore")]
    df = spark.createDataFrame([(1, "a backhand"), (2, "hand and backhand"), (3, "fore")], "k int, text string")
    got = {tuple(r) for r in Q.axis_values(df, ["k"], "text", rules, spark).collect()}
    assert got == {(1, "side", "back"), (2, "side", "back"), (2, "side", "front"), (3, "side", "front")}


def test_ordered_gap_takes_the_first_rule(spark):
    hits = Q.occurrences(spark.createDataFrame([(1, "go xx to"), (2, "to go"), (3, "go" + "x" * 100 + "to")], "k int, text string"), ["k"], "text", ["go", "to"])
    rules = spark.createDataFrame([(2, "go", "to", 6, "b"), (1, "go", "to", 4, "a")], "rule int, before string, after string, max_gap int, implies string")
    assert [tuple(r) for r in Q.ordered_gap(hits, rules, ["k"]).collect()] == [(1, 1, "a", 2)]


def test_continuation_expires(spark):
    df = spark.createDataFrame([(1, t, "x" if t < 3 else "yes") for t in range(4)] + [(2, 0, "yes"), (2, 1, "x")], "c int, t int, text string")
    got = {r.c: (r.state, r.turns) for r in Q.continuation(df, "c", "t", F.col("text") == "yes", 2).collect()}
    assert got == {1: ("expired", 2), 2: ("resolved", 1)}


def test_numbered_is_the_global_order(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("v"))
    assert all(r.pos == r.v for r in W.numbered(df.repartition(8), ["v"]).collect())


def test_review_budget_and_pools(spark):
    df = spark.range(50).select("id", (F.col("id") % 3 == 0).alias("ok"))
    got = {r.id: (r.review_rank, r.in_budget) for r in R.review_budget(df, F.col("ok"), [F.desc("id")], 4).collect()}
    assert len(got) == 50 and got[48] == (1, True) and got[36] == (5, False) and got[1] == (None, False)
    pools = {(r.pool, r.pool_rank): r.id for r in R.two_pools(df, F.col("ok"), ["id"], 2, 2).collect()}
    assert pools["core", 2] == 3 and pools["support", 1] == 1


def test_cosine_topk(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [1.0, 1.0])]
    v = spark.createDataFrame(rows, "id long, v array<double>")
    for block in (2048, 2):
        got = [(r.query_id, r.vec_id, r.cosine) for r in R.cosine_topk(v, v.where("id = 1"), 3, block).orderBy("rank").collect()]
        assert got == [(1, 2, 1.0), (1, 6, 0.7071), (1, 3, 0.0)]


def test_layers(spark):
    ranked = spark.createDataFrame([(1, "topic_related", 3.0), (2, "direct", 5.0)], "k int, tier string, score double")
    a = spark.createDataFrame([(1, 4.0, 0.9), (3, 2.0, 0.5), (4, -1.0, 0.9), (5, 3.0, 0.9)], "k int, delta double, max_similarity double")
    b = spark.createDataFrame([(1, -1.0, 0.1)], "k int, delta double, max_similarity double")
    got = {r.k: (r.tier, r.score, r.injected) for r in M.layered(ranked, {"a": a, "b": b}, spark.createDataFrame([(1,), (3,), (4,)], "k int"), "k", 0.82).collect()}
    assert got == {1: ("direct", 6.0, False), 2: ("direct", 5.0, False), 3: ("feedback_only", 2.0, True)}


def test_transitions_are_guarded(spark):
    s = spark.createDataFrame([(1, "pending"), (2, "done"), (3, "pending")], "k int, status string")
    m = spark.createDataFrame([(1, "kept"), (2, "kept"), (3, "lost")], "k int, resolution string")
    assert {tuple(r) for r in X.transition(s, m, "k", {"pending": ["kept"]}).collect()} == {(1, "kept", True), (2, "done", False), (3, "pending", False)}


def test_grams_are_whole(spark):
    text = "ab\ncdé中ab"
    assert one(spark, T.grams(F.col("t"), 3), text) == sorted({text[i : i + 3] for i in range(len(text) - 2)})


def test_replayed_batches_upsert(spark, tmp_path):
    path = f"file://{tmp_path}/u"
    write = sinks.upsert_once(spark, path, "k")
    first, second = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    for batch, i in ((first, 0), (second, 1), (first, 0), (second, 1)):
        write(batch, i)
    assert {tuple(r) for r in sinks.read_upserts(spark, path, "k").collect()} == {(1, "a"), (2, "c"), (3, "d")}


def test_bundle_stands_when_a_table_fails(spark, tmp_path):
    folder = f"file://{tmp_path}/b"
    sinks.write_bundle(spark, {"t": spark.range(2)}, folder)
    with pytest.raises(Exception):
        sinks.write_bundle(spark, {"t": spark.range(9), "u": spark.range(1).select(F.raise_error(F.lit("no")).cast("int").alias("x"))}, folder)
    assert sinks.read_bundle(spark, folder, "t").count() == 2


def test_stored_once(spark):
    calls = []
    build = lambda: calls.append(1) or spark.range(3)
    key = str(dt.datetime.now())
    assert stored.once(spark, key, [], build).count() == stored.once(spark, key, [], build).count() == 3 and len(calls) == 1


def test_late_rows_go(spark, tmp_path):
    at = lambda day: dt.datetime(2024, 1, day, 12)
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    folder = tmp_path / "in"
    for i, days in enumerate([[1, 2, 10], [10, 11], [1, 11]]):  # the last file's first row is late by more than the watermark allows
        df = spark.createDataFrame([(i * 10 + k, at(d), 1, "view", 1.0, "{}") for k, d in enumerate(days)], schema)
        df.coalesce(1).write.mode("append").parquet(f"file://{folder}")
    out = f"file://{tmp_path}/out"
    S.run_once(S.tumbling(S.read_events(spark, f"file://{folder}/*.parquet", "1 day", 1)), out, f"file://{tmp_path}/cp")
    got = {r.start.day: r.n for r in S.upserted(spark, out, ["start", "event_type"]).collect()}
    assert got == {1: 1, 2: 1, 10: 2, 11: 2}


def test_accepted_local_records(spark):
    rows = [("accepted", "local", "q", [], None), ("accepted", "local", "q", ["w"], None), ("accepted", "web", "q", None, None), ("accepted", "local", "", None, None), (None, None, None, None, "{oops"), ("accepted", "local", "q2", None, None)]
    kept, counts = tables.accepted_local(spark.createDataFrame(rows, "status string, source string, question string, warnings array<string>, _corrupt string"))
    assert sorted(r.question for r in kept.collect()) == ["q", "q2"] and tuple(counts.first()) == (6, 1, 4, 2)


def test_review_blocks(spark):
    text = "# R\n### a\n```json\n{\"x\":\n1}\n```\n### b\nno\n### a\n```json\n{}\n```\n### c\n```json\n1\n```\n```json\n2\n```\n"
    got = [(b.key, b.json, b.problem) for b in one(spark, tables.review_blocks(F.col("t")), text)]
    assert got == [("a", '{"x":\n1}', None), ("b", None, "missing"), ("a", "{}", "duplicate"), ("c", "1", "duplicate")]
