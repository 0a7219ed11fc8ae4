"""search_topk and what is built on it: which rows move, and that questions in parts give the same."""

from pyspark.sql import functions as F

from lumenquery.operators import topk as K
from lumenquery.plans import answer_queries, topk_queries
from lumenquery.sources.tables import table


def test_topk_windows_stay_together(spark, sf):
    of, _, _ = topk_queries.index(spark, sf)
    files = of.select("window", F.input_file_name().alias("file")).groupBy("window").agg(F.count_distinct("file").alias("n"))
    assert files.count() > 1 and files.where("n > 1").count() == 0


def test_topk_questions_in_parts(spark, sf, monkeypatch):
    of, terms, stats = topk_queries.index(spark, sf)
    asked = K.weighted(K.questions(table(spark, sf, "benchmark"), "item_id", "text"), terms, stats["n"])
    best, looked = (sorted(map(tuple, x.collect())) for x in K.search(of, asked, 4, (2,)))
    monkeypatch.setattr(K, "PART", 100)
    assert asked.count() > 3 * K.PART
    again = [sorted(map(tuple, x.collect())) for x in K.search(of, asked, 4, (2,))]
    assert again == [best, looked] and len(best) > 40


def test_topk_answers_move_found_texts_only(spark, sf):
    rejected = answer_queries._context(spark, sf)[2]
    rejected.collect()
    plan = rejected._jdf.queryExecution().optimizedPlan().toString().splitlines()
    read = [i for i, x in enumerate(plan) if "Relation" in x and "text#" in x]
    assert read and all(any("LeftSemi" in x for x in plan[i - 3 : i]) for i in read)
