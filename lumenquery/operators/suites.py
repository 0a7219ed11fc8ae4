"""AGG-09, GV-01, FN-29: metrics of a retrieval against gold documents, and suites of metrics against their floors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cases(found: DataFrame, gold: DataFrame, known: DataFrame, k: int) -> DataFrame:
    """One row a question with gold documents: found (question, rank, doc_id), gold (question, doc_id, gain), known (doc_id, bad): documents that were judged at all.

    recall, reciprocal rank and nDCG of the first k; precision of those among them that are known; bad ones among them.
    """
    top = found.where(F.col("rank") <= k).join(gold, ["question", "doc_id"], "left").join(known, "doc_id", "left")
    dcg = lambda gain, rank: gain / F.log2(rank + 1.0)
    got = top.groupBy("question").agg(
        F.count("gain").alias("hits"),
        F.min(F.when(F.col("gain").isNotNull(), F.col("rank"))).alias("first"),
        F.sum(F.coalesce(dcg(F.col("gain"), F.col("rank")), F.lit(0.0))).alias("dcg"),
        F.count_if(F.col("gain").isNotNull() | F.col("bad").isNotNull()).alias("judged"),
        F.count_if(F.coalesce("bad", F.lit(False))).alias("bad"),
    )
    best = F.slice(F.sort_array(F.collect_list("gain"), False), 1, k)
    ideal = F.aggregate(F.transform(best, lambda g, i: g / F.log2(i + 2.0)), F.lit(0.0), lambda a, x: a + x)
    want = gold.groupBy("question").agg(F.count("*").alias("expected"), ideal.alias("ideal"))
    x = want.join(got, "question", "left").na.fill(0, ["hits", "dcg", "judged", "bad"])
    return x.select(
        "question", "expected", "hits", (F.col("hits") / F.least(F.col("expected"), F.lit(k))).alias("recall"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr"), (F.col("dcg") / F.col("ideal")).alias("ndcg"),
        F.when(F.col("judged") > 0, F.col("hits") / F.col("judged")).alias("known_precision"), F.coalesce(F.col("first") == 1, F.lit(False)).alias("primary"), "bad",
    )


def metrics(of: DataFrame, suite: str) -> DataFrame:
    """(suite, metric, value) of cases."""
    value = {
        "cases": F.count("*").cast("double"), "recall": F.avg("recall"), "primary_top_k": F.avg(F.col("primary").cast("double")), "mean_reciprocal_rank": F.avg("rr"), "mean_ndcg": F.avg("ndcg"), "mean_known_precision": F.avg("known_precision"),
        "violations": F.sum("bad").cast("double"),
    }
    one = of.agg(*[F.round(v, 4).alias(k) for k, v in value.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).alias("value")) for k in value])).alias("m")).select(F.lit(suite).alias("suite"), "m.*")


def compared(values: DataFrame, floors: DataFrame) -> DataFrame:
    """(suite, metric, value, floor, status): of metrics against floors (suite, metric, floor, direction, tolerance): ok, regressed, missing (no value) or new (no floor).

    A metric of direction 'higher' may fall short of its floor by the tolerance, one of 'lower' may exceed it, one of 'equal' may differ by it.
    """
    j = values.join(floors, ["suite", "metric"], "full")
    gap = F.when(F.col("direction") == "higher", F.col("floor") - F.col("value")).when(F.col("direction") == "lower", F.col("value") - F.col("floor")).otherwise(F.abs(F.col("value") - F.col("floor")))
    status = F.when(F.col("floor").isNull(), "new").when(F.col("value").isNull(), "missing").when(gap > F.coalesce("tolerance", F.lit(0.0)) + 1e-9, "regressed").otherwise("ok")
    return j.select("suite", "metric", "value", "floor", status.alias("status"))
