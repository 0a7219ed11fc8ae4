"""Evaluation of the search over all benchmark items, and the report against floors (AGG-09, GV-01, JON-19)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenquery.functions import text as T
from lumenquery.operators import automaton as A
from lumenquery.operators import suites as S
from lumenquery.sources.tables import table

from .literals import Rules
from .retrieval_queries import _F, _fields
from .text_queries import NORM
from .topk_queries import ORACLES as TOPK
from .topk_queries import TOP, search_topk

FLOORS = Rules("fl", "suite string, metric string, floor double, direction string, tolerance double", [
    ("all", "recall", 0.9, "higher", 0.05), ("all", "mean_reciprocal_rank", 0.55, "higher", 0.0), ("all", "mean_ndcg", 0.7, "higher", 0.0), ("all", "violations", 0.0, "lower", 0.0), ("all", "average_candidates", 40.0, "lower", 0.0),
    ("short", "recall", 0.9, "higher", 0.05), ("short", "primary_top_k", 1.0, "equal", 0.1),
])


def _gold(spark, d):
    """(question, doc_id, gain): documents that hold a whole benchmark item, 2 if in a title."""
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("question"), T.norm(F.col("text")).alias("term"))
    hit = A.counts(_fields(spark, d), ["doc_id"], ["title", "body"], items.select("term"))
    return hit.join(items, "term").select("question", "doc_id", F.when(F.col("n_title") > 0, 2).otherwise(1).alias("gain"))


def retrieval_cases(spark, d):
    """AGG-09, JON-19: every benchmark item that some document holds as a case of its own."""
    known = table(spark, d, "labels").groupBy("doc_id").agg((F.max("toxic") == 1).alias("bad"))
    c = S.cases(search_topk(spark, d), _gold(spark, d), known, TOP)
    return c.select("question", "expected", "hits", *[F.round(x, 4).alias(x) for x in ("recall", "rr", "ndcg", "known_precision")], "primary", "bad")


def evaluation_report(spark, d):
    """GV-01: two suites of metrics against their floors; a floor without a metric and a metric without a floor are told."""
    c = retrieval_cases(spark, d).checkpoint()
    short = table(spark, d, "benchmark").where("length(text) < 200").select(F.col("item_id").alias("question"))
    values = S.metrics(c, "all").union(S.metrics(c.join(short, "question", "left_semi"), "short"))
    return S.compared(values, FLOORS.df(spark))


QUERIES = {f.__name__: f for f in (retrieval_cases, evaluation_report)}

_CASES = f"""WITH tk AS ({TOPK['search_topk']}), {_F}, b AS (SELECT item_id AS question, {NORM.format('text')} AS t FROM benchmark), g AS (SELECT question, doc_id, CASE WHEN contains(title, t) THEN 2 ELSE 1 END AS gain FROM b JOIN f ON t <> '' AND (contains(body, t) OR contains(title, t))),
k AS (SELECT doc_id, max(toxic) = 1 AS bad FROM labels GROUP BY 1), w AS (SELECT question, count(*) AS expected, list_sort(list(gain), 'DESC')[1:10] AS best FROM g GROUP BY 1),
i AS (SELECT question, expected, list_sum(list_transform(range(1, len(best) + 1), lambda r: best[r] / log2(r + 1))) AS ideal FROM w),
h AS (SELECT tk.question, count(gain) AS hits, min(CASE WHEN gain IS NOT NULL THEN rank END) AS first, sum(coalesce(gain / log2(rank + 1), 0)) AS dcg, count(*) FILTER (WHERE gain IS NOT NULL OR bad IS NOT NULL) AS judged, count(*) FILTER (WHERE bad) AS bad
FROM tk LEFT JOIN g ON g.question = tk.question AND g.doc_id = tk.doc_id LEFT JOIN k ON k.doc_id = tk.doc_id GROUP BY 1),
c AS (SELECT i.question, expected, coalesce(hits, 0) AS hits, round(coalesce(hits, 0) / least(expected, 10), 4) AS recall, round(coalesce(1.0 / first, 0), 4) AS rr, round(coalesce(dcg, 0) / ideal, 4) AS ndcg, round(CASE WHEN judged > 0 THEN hits / judged END, 4) AS known_precision,
coalesce(first = 1, false) AS "primary", coalesce(bad, 0) AS bad FROM i LEFT JOIN h ON h.question = i.question)"""
_METRICS = "SELECT '{0}' AS suite, unnest(['cases', 'recall', 'primary_top_k', 'mean_reciprocal_rank', 'mean_ndcg', 'mean_known_precision', 'violations']) AS metric, unnest([CAST(count(*) AS DOUBLE), round(avg(recall), 4), round(avg(CAST(\"primary\" AS INTEGER)), 4), round(avg(rr), 4), round(avg(ndcg), 4), round(avg(known_precision), 4), CAST(sum(bad) AS DOUBLE)]) AS value FROM c {1}"

ORACLES = {
    "retrieval_cases": f"{_CASES} SELECT question, expected, hits, CAST(recall AS DOUBLE) AS recall, CAST(rr AS DOUBLE) AS rr, CAST(ndcg AS DOUBLE) AS ndcg, CAST(known_precision AS DOUBLE) AS known_precision, \"primary\", bad FROM c",
    "evaluation_report": f"""{_CASES}, {FLOORS.sql}, v AS ({_METRICS.format('all', '')} UNION ALL {_METRICS.format('short', 'WHERE question IN (SELECT item_id FROM benchmark WHERE length(text) < 200)')})
SELECT suite, metric, value, floor, CASE WHEN floor IS NULL THEN 'new' WHEN value IS NULL THEN 'missing' WHEN CASE direction WHEN 'higher' THEN floor - value WHEN 'lower' THEN value - floor ELSE abs(value - floor) END > tolerance + 1e-9 THEN 'regressed' ELSE 'ok' END AS status FROM v FULL JOIN fl USING (suite, metric)""",
}
