"""A stored search index and what reads it: keyword, semantic and hybrid ranking, lookup, coverage (RT-01..03, RT-08, RT-09, RT-11, JON-06, JON-09, FN-04)."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenquery.functions import text as T

from . import automaton as A
from . import retrieval as R

GRAM_WEIGHTS = {"title": 24.0, "body": 14.0}
FOCUS_BONUS, FOCUS_MOST = {"title": 33.0, "body": 8.0}, 3


def lexicon_postings(fields: DataFrame, lexicon: DataFrame) -> DataFrame:
    """JON-06: (term, doc_id, tf and length of each field) of the lexicon's terms that a field holds, from one pass over the fields, however long the lexicon is."""
    names = list(R.FIELD_WEIGHTS)
    x = fields.select("doc_id", *names, *[F.length(n).alias(f"len_{n}") for n in names])
    hit = A.counts(x, ["doc_id", *(f"len_{n}" for n in names)], names, lexicon.select("term"))
    return hit.select("term", "doc_id", *[f"len_{n}" for n in names], *[F.col(f"n_{n}").cast("int").alias(f"tf_{n}") for n in names])


def gram_postings(fields: DataFrame, sizes: dict[str, list[int]]) -> DataFrame:
    """FN-04: (channel, gram_id, doc_id): the distinct hashed grams of each field."""
    out = None
    for n, ks in sizes.items():
        part = fields.select(F.lit(n).alias("channel"), F.explode(F.concat(*[T.grams(F.col(n), k) for k in ks])).alias("g"), "doc_id")
        out = part if out is None else out.union(part)
    return out.select("channel", T.gram_hash(F.col("g")).alias("gram_id"), "doc_id")


def statistics(fields: DataFrame) -> DataFrame:
    """One row: documents, and the average length of each field."""
    return fields.agg(F.count("*").alias("n"), *[F.round(F.avg(F.length(c)), 4).alias(f"avg_{c}") for c in R.FIELD_WEIGHTS])


def keyword_scores(postings: DataFrame, stats: DataFrame, weights: dict[str, float]) -> DataFrame:
    """RT-02: (doc_id, bm25, n_terms) from stored postings: only the rows of the query's terms are read."""
    p = postings.where(F.col("term").isin(list(weights)))
    df = p.groupBy("term").agg(F.count("*").alias("df"))
    j = p.join(F.broadcast(df), "term").join(F.broadcast(stats))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.create_map(*[x for t, w in weights.items() for x in (F.lit(t), F.lit(w))])[F.col("term")]
    score = F.lit(0.0)
    for c, fw in R.FIELD_WEIGHTS.items():
        tf = F.least(F.col(f"tf_{c}"), F.lit(R.TF_CAP))
        score = score + fw * tf * (R.K1 + 1) / (tf + R.K1 * (1 - R.B + R.B * F.col(f"len_{c}") / F.greatest(F.lit(1.0), F.col(f"avg_{c}"))))
    return j.groupBy("doc_id").agg(F.round(F.sum(weight * idf * score), 4).alias("bm25"), F.count("*").alias("n_terms"))


def semantic_scores(grams: DataFrame, stats: DataFrame, query: str, k: int) -> DataFrame:
    """RT-02/03: (doc_id, gram_score): weighted coverage of the query's grams by each channel; a gram's df counts a document once."""
    # the question's hashes stand in the filter, which the scan takes: the other grams' row groups aren't read
    asked = sorted({hashlib.md5(query[i : i + k].encode()).hexdigest()[:12] for i in range(len(query) - k + 1)})
    hit = grams.where(F.col("gram_id").isin(asked))
    df = hit.groupBy("gram_id").agg(F.countDistinct("doc_id").alias("df"))
    w = df.join(F.broadcast(stats)).select("gram_id", F.log(1 + (F.col("n") + 1) / (F.col("df") + 1)).alias("w"))
    total = w.agg(F.sum("w").alias("total"))
    per = hit.join(F.broadcast(w), "gram_id").groupBy("doc_id").agg(*[F.sum(F.when(F.col("channel") == c, F.col("w")).otherwise(0.0)).alias(c) for c in GRAM_WEIGHTS])
    share = lambda c: F.col(c) / F.greatest(F.lit(1.0), F.col("total"))
    return per.join(F.broadcast(total)).select("doc_id", F.round(sum((x * share(c) for c, x in GRAM_WEIGHTS.items()), F.lit(0.0)), 4).alias("gram_score"))


def focus_bonus(focus: list[str]) -> Column:
    """RT-02: a bonus a focus term, by its length, for the first FOCUS_MOST that a title or body holds."""
    hits = lambda c: F.least(F.lit(FOCUS_MOST), sum((F.contains(F.col(c), F.lit(f)).cast("int") for f in focus), F.lit(0)))
    return sum((w * hits(c) for c, w in FOCUS_BONUS.items()), F.lit(0.0))


def ranked(fields: DataFrame, keyword: DataFrame, semantic: DataFrame, topics: DataFrame, quality: DataFrame, concepts: list[str], focus: list[str], mode: str) -> DataFrame:
    """RT-02/03: every document that a channel of the mode names, with the parts of its score.

    keyword mode drops the gram channel, semantic mode the fields and topics; concepts and quality count in all.
    """
    use = {"keyword": ("bm25", "topics", "focus"), "semantic": ("grams",), "hybrid": ("bm25", "topics", "focus", "grams")}[mode]
    n = sum((F.contains(F.col("body"), F.lit(c)).cast("int") for c in concepts), F.lit(0))
    part = {"bm25": F.coalesce("bm25", F.lit(0.0)), "topics": 2.0 * F.coalesce("n_topics", F.lit(0)), "grams": F.coalesce("gram_score", F.lit(0.0)), "focus": focus_bonus(focus)}
    x = fields.join(keyword, "doc_id", "left").join(semantic, "doc_id", "left").join(topics.groupBy("doc_id").agg(F.count("*").alias("n_topics")), "doc_id", "left").join(quality, "doc_id", "left")
    named = F.lit(False)
    if "bm25" in use:
        named = named | F.col("bm25").isNotNull() | F.col("n_topics").isNotNull()
    if "grams" in use:
        named = named | (F.col("gram_score") >= 4)
    parts = {k: F.round(c, 4) if k in use else F.lit(0.0) for k, c in part.items()}
    parts |= {"concepts": 4.0 * n, "quality": F.coalesce("bonus", F.lit(0.0))}
    x = x.where(named).select("doc_id", *[c.alias(k) for k, c in parts.items()])
    return x.withColumn("score", F.round(sum((F.col(k) for k in parts), F.lit(0.0)), 4))


def lookup(ids: DataFrame, docs: DataFrame, allowed: Column) -> DataFrame:
    """RT-09: every id that was asked for: found, rejected by `allowed`, or missing."""
    j = ids.join(docs, "doc_id", "left")
    return j.withColumn("outcome", F.when(F.col("text").isNull(), "missing").when(allowed, "found").otherwise("rejected"))
