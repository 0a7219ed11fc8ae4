"""Tables that change in transactions, and the index that grows with them (SNK-03, ST-01, RT-01)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lumenquery.functions import text as T
from lumenquery.operators import updates as U
from lumenquery.operators.segments import GrowingIndex
from lumenquery.operators.topk import WORDS, words
from lumenquery.sources.journal import Journal
from lumenquery.sources.stored import shared_folder
from lumenquery.sources.tables import table


def _folder(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def update_fanout(spark, d):
    """ST-01: labelled documents come first; then all documents arrive, and the same snapshot arrives again."""
    j = Journal(spark, _folder(spark, "update"))
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", F.size(words(F.col("text"))).alias("words"), F.contains(F.coalesce("text", F.lit("")), F.lit("http")).alias("links"))
    known = table(spark, d, "labels").select("doc_id").distinct().join(docs, "doc_id")
    few, link = F.col("words") < 20, F.col("links")
    decision = F.when(few, "excluded").when(link, "review").otherwise("teaching")
    reason = F.when(few, "too_short").when(link, "has_links").otherwise("has_text")
    U.apply_update(j, known, "doc_id", decision, reason, "labelled")
    U.apply_update(j, docs, "doc_id", decision, reason, "all")
    U.apply_update(j, docs, "doc_id", decision, reason, "all")
    ledger = j.read("ledger").join(j.read("queue").select("doc_id", "status", "attempts"), "doc_id", "left").join(j.read("index").select("doc_id", "words"), "doc_id")
    counts = ledger.groupBy("batch", "decision", "reason", "status").agg(F.count("*").alias("n"), F.sum("words").alias("words"))
    return counts.join(j.read("discovery"), "batch")


def growing_index(spark, d):
    """RT-01, ST-01: all documents, then those of low quality cut to their first line, then toxic ones taken out; a word's documents and occurrences."""
    g = GrowingIndex(spark, _folder(spark, "index"))
    docs = table(spark, d, "documents").groupBy("doc_id").agg(F.min("text").alias("text"))
    labels = table(spark, d, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    none = docs.select("doc_id").limit(0)
    g.apply(docs, none)
    g.apply(docs.join(labels.where("quality = 0"), "doc_id").select("doc_id", T.first_line(F.col("text")).alias("text")), none)
    g.apply(docs.limit(0), labels.where("toxic = 1").select("doc_id"))
    g.apply(docs.join(labels.where("quality = 1 and toxic = 1"), "doc_id").select("doc_id", "text"), none)  # four segments: they are merged
    return g.postings().groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


QUERIES = {f.__name__: f for f in (update_fanout, growing_index)}

_WORDS = f"regexp_extract_all(lower(coalesce(text, '')), '{WORDS}')"

ORACLES = {
    "update_fanout": f"""WITH x AS (SELECT doc_id, len({_WORDS}) AS w, contains(coalesce(text, ''), 'http') AS l, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'labelled' ELSE 'all' END AS batch FROM documents),
y AS (SELECT *, CASE WHEN w < 20 THEN 'excluded' WHEN l THEN 'review' ELSE 'teaching' END AS decision, CASE WHEN w < 20 THEN 'too_short' WHEN l THEN 'has_links' ELSE 'has_text' END AS reason FROM x),
c AS (SELECT batch, count(*) AS arrived, count(*) FILTER (WHERE decision = 'teaching') AS teaching, count(*) FILTER (WHERE decision = 'review') AS review, count(*) FILTER (WHERE decision = 'excluded') AS excluded FROM y GROUP BY 1)
SELECT batch, decision, reason, CASE decision WHEN 'review' THEN 'needs_review' WHEN 'teaching' THEN 'pending' END AS status, count(*) AS n, CAST(sum(w) AS BIGINT) AS words, arrived, teaching, review, excluded FROM y JOIN c USING (batch) GROUP BY ALL""",
    "growing_index": f"""WITH l AS (SELECT doc_id, min(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1),
t AS (SELECT doc_id, CASE WHEN quality = 0 THEN split_part(text, chr(10), 1) ELSE text END AS text FROM documents LEFT JOIN l USING (doc_id) WHERE NOT (coalesce(toxic, 0) = 1 AND coalesce(quality, 0) <> 1)),
w AS (SELECT doc_id, unnest({_WORDS}) AS term FROM t) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS tf FROM w GROUP BY 1""",
}
