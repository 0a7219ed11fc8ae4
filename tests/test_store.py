"""Transactions that are cut off between any two steps, other writers, an index that grows, tables derived once."""

import tempfile
from collections import Counter

import pytest

from lumenquery.operators import topk as K
from lumenquery.operators import updates as U
from lumenquery.operators.segments import FAN, GrowingIndex
from lumenquery.plans import topk_queries
from lumenquery.sources.journal import Conflict, Journal
from lumenquery.sources.stored import fingerprint, once
from lumenquery.sources.tables import table


@pytest.fixture
def folder():
    return "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def rows(j, name):
    return sorted(tuple(r) for r in j.read(name, schema="a long").collect())


STEPS = ["staged left", "staged right", "intended", "committed", "done"]


@pytest.mark.parametrize("stop", STEPS)
def test_journal_cut_off_between_any_two_steps(spark, folder, stop):
    df = lambda *v: spark.createDataFrame([(x,) for x in v], "a long")
    Journal(spark, folder).commit({"left": df(1), "right": df(1)})

    def cut(step):
        if step == stop:
            raise KeyboardInterrupt

    j = Journal(spark, folder)
    j.step = cut
    with pytest.raises(KeyboardInterrupt):
        j.commit({"left": df(2), "right": df(2)})
    seen = Journal(spark, folder)
    assert rows(seen, "left") == rows(seen, "right")  # before anything is mended, too
    told = list(seen.recover().values())
    assert rows(seen, "left") == rows(seen, "right") == ([(1,)] if "staged" in stop else [(1,), (2,)])
    assert told == {"staged left": ["taken back"], "staged right": ["taken back"], "intended": ["carried out"], "committed": ["ended"], "done": []}[stop]
    assert seen.recover() == {}
    assert seen.commit({"left": df(3), "right": df(3)}) == (2 if "staged" in stop else 3)
    assert rows(seen, "left") == rows(seen, "right")


def test_journal_damaged_or_overtaken_files_are_taken_back(spark, folder):
    df = lambda *v: spark.createDataFrame([(x,) for x in v], "a long")
    for damage in (True, False):
        j = Journal(spark, folder)
        base = j.version()

        def cut(step):
            if step == "intended":
                raise KeyboardInterrupt

        j.step = cut
        with pytest.raises(KeyboardInterrupt):
            j.commit({"left": df(7)})
        other = Journal(spark, folder)
        if damage:
            txn = other._names("_intent")[0]
            path = [x for x in other._names("data", txn, "left") if x.startswith("part")][0]
            out = other.fs.create(other._path("data", txn, "left", path), True)
            out.write(bytearray(b"torn"))
            out.close()
        else:
            other.commit({"left": df(8)})
        assert list(other.recover().values()) == ["taken back"]
        assert (7,) not in rows(other, "left") and other.version() == base + (not damage)


def test_journal_second_writer_loses(spark, folder):
    df = lambda *v: spark.createDataFrame([(x,) for x in v], "a long")
    j = Journal(spark, folder)
    base = j.version()
    assert j.commit({"left": df(1)}, base) == 1
    with pytest.raises(Conflict):
        j.commit({"left": df(2)}, base)
    assert rows(j, "left") == [(1,)] and j._names("_intent") == [] and len(j._names("data")) == 1
    j.commit({"left": df(3)}, replace=True)
    assert rows(j, "left") == [(3,)] and sorted(tuple(r) for r in j.read("left", 1).collect()) == [(1,)]
    j.commit({}, removes={"left": [2]})
    assert rows(j, "left") == []


def test_growing_index_equals_a_rebuild(spark, folder):
    texts = {1: "a b a. c", 2: "b", 3: None, 4: "", 5: "x y z"}
    df = lambda t: spark.createDataFrame(list(t.items()), "doc_id long, text string")
    ids = lambda *v: spark.createDataFrame([(x,) for x in v], "doc_id long")
    g = GrowingIndex(spark, folder)
    batches = [(texts, []), ({2: "b b new", 6: "a"}, []), ({}, [1, 99]), ({1: "back again"}, [5]), ({7: "q"}, []), ({7: "r"}, [6]), ({}, [7]), ({8: "s t"}, []), ({}, [2])]
    state = {}
    for i, (changed, deleted) in enumerate(batches):
        g.apply(df(changed), ids(*deleted))
        state = {k: v for k, v in {**state, **changed}.items() if k not in deleted}
        want = Counter((w.strip(".,"), k) for k, t in state.items() for w in (t or "").split())
        assert {(r.term, r.doc_id): r.tf for r in g.postings().collect()} == dict(want), i
        assert sorted(r.doc_id for r in g.current().collect()) == sorted(state)
        assert max(Counter(g.segments().values()).values()) < FAN
    again = GrowingIndex(spark, folder)  # as the next application
    assert {(r.term, r.doc_id): r.tf for r in again.postings().collect()} == dict(want)
    assert len(g.segments()) < len(batches)


def test_growing_index_follows_its_input(spark, folder):
    path = f"{folder}/docs.parquet"
    put = lambda *t: spark.createDataFrame(t, "doc_id long, text string").write.mode("overwrite").parquet(path)
    g = GrowingIndex(spark, f"{folder}/index")
    put((1, "a"), (2, "b"), (None, "c"))
    assert g.sync(path) == {"added": 2, "changed": 0, "removed": 0} and g.sync(path) is None
    put((1, "a"), (2, "b b"), (3, "c"))
    assert g.sync(path) == {"added": 1, "changed": 1, "removed": 0}
    put((3, "c"))
    assert GrowingIndex(spark, f"{folder}/index").sync(path) == {"added": 0, "changed": 0, "removed": 2}
    assert [tuple(r) for r in g.postings().collect()] == [("c", 3, 1)]


def test_update_batches_count_once(spark, folder):
    from pyspark.sql import functions as F

    j = Journal(spark, folder)
    snap = lambda *k: spark.createDataFrame([(x, x * 10) for x in k], "k long, v long")
    go = lambda s, name: U.apply_update(j, s, "k", F.when(F.col("v") > 20, "teaching").when(F.col("v") > 10, "review").otherwise("excluded"), F.lit("r"), name)
    assert [go(snap(1, 2), "one"), go(snap(1, 2, 3, 3), "two"), go(snap(9), "two")] == [1, 2, 2]
    assert sorted((r.k, r.decision, r.batch) for r in j.read("ledger").collect()) == [(1, "excluded", "one"), (2, "review", "one"), (3, "teaching", "two")]
    assert sorted((r.k, r.status) for r in j.read("queue").collect()) == [(2, "needs_review"), (3, "pending")]
    assert sorted((r.batch, r.arrived) for r in j.read("discovery").collect()) == [("one", 2), ("two", 1)]


def test_stored_tables_notice_a_changed_input(spark, folder):
    path, built = f"{folder}/t", []
    make = lambda: (built.append(1), spark.read.parquet(path))[1]
    spark.range(3).write.parquet(path)
    before = fingerprint(spark, path)
    assert [once(spark, "test", [path], make).count() for _ in range(2)] == [3, 3] and len(built) == 1
    spark.range(5).write.mode("overwrite").parquet(path)
    assert once(spark, "test", [path], make).count() == 5 and len(built) == 2 and fingerprint(spark, path) != before


@pytest.mark.parametrize("window, rounds", [(4, (1, 3)), (64, ()), (1, (50,))])
def test_topk_equals_all_scores(spark, sf, window, rounds):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "text")
    docs = docs.union(spark.createDataFrame([(10_001, None, None), (10_002, "en", ""), (10_003, "en", "of the"), (10_004, "en", "of the"), (None, "en", "of the")], docs.schema))
    stats = K.lengths(docs.where("doc_id is not null")).first().asDict()
    of = K.blocks(K.postings(docs, window), stats)
    asked = K.weighted(K.questions(table(spark, sf, "benchmark"), "item_id", "text"), K.terms(of), stats["n"]).cache()
    every = of.join(asked, "term").selectExpr("question", "weight", "explode(docs) x").groupBy("question", "x.doc_id").agg({"*": "count"}).count()
    best, looked = K.search(of, asked, 3, rounds)
    got, want = {}, {}
    for r in best.collect():
        got.setdefault(r.question, []).append((r.rank, r.doc_id, r.score))
    for r in of.join(asked, "term").selectExpr("question", "weight", "explode(docs) x").selectExpr("question", "x.doc_id", "weight * x.impact s").groupBy("question", "doc_id").sum("s").collect():
        want.setdefault(r.question, []).append((-r["sum(s)"], r.doc_id))
    assert {q: sorted(v) for q, v in got.items()} == {q: [(i, d, -s) for i, (s, d) in enumerate(sorted(v)[:3], 1)] for q, v in want.items()} and every
    for r in looked.collect():
        assert 0 < r.looked_at <= r.windows
    if rounds and window == 1:
        assert sum(r.looked_at for r in looked.collect()) < 0.7 * sum(r.windows for r in looked.collect())  # a window of one document is bounded by its own score


def test_topk_questions_of_no_known_word(spark, sf):
    of, terms, stats = topk_queries.index(spark, sf)
    asked = K.weighted(K.questions(spark.createDataFrame([(1, "zzzzqq"), (2, None)], "item_id long, text string"), "item_id", "text"), terms, stats["n"])
    assert K.search(of, asked, 3)[0].count() == 0
