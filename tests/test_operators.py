"""Invariants of operators on small inputs."""

from pyspark.sql import functions as F

from lumenquery.functions import text as T
from lumenquery.operators import evidence as E
from lumenquery.operators import windows as W
from lumenquery.plans import registry
from lumenquery.sources import sinks, tables


def one(spark, c, text):
    return spark.createDataFrame([(text,)], "t string").select(c).first()[0]


def test_normalisers(spark):
    assert one(spark, T.norm(F.col("t")), "Ab c-9 Ä") == "abc9"
    assert one(spark, T.grams(F.col("t"), 3), "ab") == []
    assert one(spark, T.grams(F.col("t"), 2), "abab") == ["ab", "ba"]
    assert one(spark, T.occurrences(F.col("t"), "aa"), "aaaaa") == 2
    assert one(spark, T.shorten(F.col("t"), 3), "abcd") == "ab…"
    assert one(spark, T.clock(F.lit(61)), "") == "01:01"


def test_constraint_match(spark):
    rows = [(["a"], ["a"], [], "exact"), (["a"], ["a", "b"], [], "mixed_support"), (["a", "b"], ["a"], [], "partial_support"), (["a"], ["b"], [], "conflict"), (["a"], [], [], "unspecified_support"), (["a"], [], ["a"], "conflict")]
    df = spark.createDataFrame(rows, "r array<string>, f array<string>, s array<string>, want string")
    assert df.where(E.constraint_match(F.col("r"), F.col("f"), F.col("s")) != F.col("want")).count() == 0


def test_greedy_windows_do_not_overlap(spark):
    df = spark.createDataFrame([(1, 0, 2, 5), (1, 2, 4, 9), (1, 5, 6, 1), (2, 0, 0, 1)], "key int, w_start int, w_end int, score int")
    assert {(r.key, r.w_start) for r in W.greedy_windows(df, "key", 2).collect()} == {(1, 2), (1, 5), (2, 0)}


def test_apportion_keeps_the_total(spark):
    df = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "k string, w int")
    assert sorted(r.share for r in W.apportion(df, "k", "w", 10).collect()) == [3, 3, 4]


def test_sections(spark):
    got = one(spark, tables.sections(F.col("t")), "x\n### One\n a b \n### Two\n_No response_")
    assert got == {"One": "a b", "Two": ""}


def test_bundle_shows_the_last_version(spark, tmp_path):
    folder = f"file://{tmp_path}/b"
    sinks.write_bundle(spark, {"t": spark.range(2)}, folder)
    sinks.write_bundle(spark, {"t": spark.range(5)}, folder)
    assert sinks.read_bundle(spark, folder, "t").count() == 5


def test_corrupt_json_is_kept_aside(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": 1}')
    (tmp_path / "b.json").write_text("{oops")
    got = {r.file_key: (r.id, r._corrupt is None) for r in tables.json_directory(spark, f"file://{tmp_path}", "id int").collect()}
    assert got == {"a": (1, True), "b": (None, False)}


def test_shape_tolerant(spark):
    df = spark.createDataFrame([(None, [("x", 1), ("x", 2), ("", 3)])], "videos array<struct<id:string,v:int>>, items array<struct<id:string,v:int>>")
    assert [tuple(r) for r in tables.shape_tolerant(df, ["videos", "items"], "id").collect()] == [("x", 1)]


def test_diversify_cover_takes_all_documents(spark, sf):
    marks = ["tion", "ment", "able", "lich", "eau", "ado"]
    by = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        by.setdefault(r.lang, []).append((r.doc_id, {m for m in marks if m in (r.text or "")}, r.n_chars))
    want = set()
    for lang, left in by.items():
        seen = set()
        for i in range(min(5, len(left))):
            best = min(left, key=lambda r: (-len(r[1] - seen), -r[2], r[0]))
            left.remove(best)
            seen |= best[1]
            want.add((lang, i + 1, best[0]))
    assert {tuple(r) for r in registry.queries()["diversify_cover"](spark, sf).collect()} == want
