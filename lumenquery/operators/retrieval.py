"""Index, ranking, tiers, budgets, pages, fusion and quotas (RT-*, QU-03, FN-07/31, JON-06/07/10, SRT-*, AGG-02/05/15, WIN-04)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenquery.functions import text as T

from .windows import numbered

K1, B, TF_CAP = 1.35, 0.72, 8
FIELD_WEIGHTS = {"title": 4.0, "body": 1.0}
TIER_BONUS = {"direct": 12.0, "strong_related": 6.0, "topic_related": 1.0, "semantic_lead": 0.0}


def fields(docs: DataFrame) -> DataFrame:
    """Normalised title (first line) and body of each document."""
    return docs.select("doc_id", "lang", "source", T.norm(T.first_line(F.col("text"))).alias("title"), T.norm(F.col("text")).alias("body"))


def term_stats(f: DataFrame, terms: list[str]) -> DataFrame:
    """RT-01, JON-06/08: (doc_id, term, tf and length of each field) where a term is in any field; non-overlapping counts."""
    names = list(FIELD_WEIGHTS)
    per = F.array(*[F.struct(F.lit(t).alias("term"), *[T.occurrences(F.col(n), t).alias(f"tf_{n}") for n in names]) for t in terms])
    x = f.select("doc_id", *[F.length(n).alias(f"len_{n}") for n in names], F.explode(per).alias("p")).select("doc_id", *[f"len_{n}" for n in names], "p.*")
    return x.where(" + ".join(f"tf_{n}" for n in names) + " > 0")


def bm25f(f: DataFrame, weights: dict[str, float]) -> DataFrame:
    """FN-07: (doc_id, bm25, n_terms) over the query's terms and their weights.

    Postings are made in one scan and carry their field lengths; df and average lengths are small
    aggregates that are broadcast back (as many rows as terms).
    """
    names = list(FIELD_WEIGHTS)
    p = term_stats(f, list(weights))
    df = p.groupBy("term").agg(F.count("*").alias("df"))
    avg = f.agg(F.count("*").alias("n"), *[F.round(F.avg(F.length(n)), 4).alias(f"avg_{n}") for n in names])
    j = p.join(F.broadcast(df), "term").join(F.broadcast(avg))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.create_map(*[x for t, w in weights.items() for x in (F.lit(t), F.lit(w))])[F.col("term")]
    score = F.lit(0.0)
    for n in names:
        tf = F.least(F.col(f"tf_{n}"), F.lit(TF_CAP))
        score = score + FIELD_WEIGHTS[n] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col(f"len_{n}") / F.greatest(F.lit(1.0), F.col(f"avg_{n}"))))
    return j.groupBy("doc_id").agg(F.round(F.sum(weight * idf * score), 4).alias("bm25"), F.count("*").alias("n_terms"))


def gram_channel(f: DataFrame, query: str) -> DataFrame:
    """JON-09, RT-02: weighted coverage of the query's 2-grams by title and by body; df counts a document once."""
    q = sorted({query[i : i + 2] for i in range(len(query) - 1)})
    has = lambda c: F.array_compact(F.array(*[F.when(F.contains(F.col(c), F.lit(g)), F.lit(g)) for g in q]))
    x = f.select("doc_id", has("title").alias("gt"), has("body").alias("gb"))
    df = x.select(F.explode(F.array_union("gt", "gb")).alias("g")).groupBy("g").agg(F.count("*").alias("df"))
    w = df.join(F.broadcast(f.agg(F.count("*").alias("n")))).select("g", F.log(1 + (F.col("n") + 1) / (F.col("df") + 1)).alias("w"))
    total = w.agg(F.sum("w").alias("total"))
    part = lambda c: x.select("doc_id", F.explode(c).alias("g")).join(F.broadcast(w), "g").groupBy("doc_id").agg(F.sum("w").alias(c), F.count("*").alias(f"n_{c}"))
    j = part("gb").join(part("gt"), "doc_id", "left").join(F.broadcast(total))
    ct, cb = F.coalesce("gt", F.lit(0.0)) / F.greatest(F.lit(1.0), F.col("total")), F.col("gb") / F.greatest(F.lit(1.0), F.col("total"))
    return j.where((F.greatest("n_gb", F.coalesce("n_gt", F.lit(0))) >= 2) & (F.greatest(ct, cb) >= 0.12)).select("doc_id", F.round(24 * ct + 14 * cb, 4).alias("gram_score"))


def tier(concepts_title: Column, concepts: Column, expanded: Column, grams: Column) -> Column:
    """FN-31: ordinal CASE; null drops the row."""
    return F.when(concepts_title >= 2, "direct").when((concepts >= 2) | (concepts_title >= 1), "strong_related").when(expanded, "topic_related").when(grams, "semantic_lead")


def exclusion_penalty(seed_hits: Column, expanded_hits: Column) -> Column:
    """RT-04."""
    return 150 * F.least(F.lit(3), seed_hits) + 20 * F.least(F.lit(3), expanded_hits)


def topic_scores(f: DataFrame, rules: DataFrame) -> DataFrame:
    """JON-07: topic rules (topic, keywords, context_any, minimum) meet documents; weighted non-overlapping hits."""
    j = f.join(F.broadcast(rules))
    hits = lambda c: F.aggregate("keywords", F.lit(0).cast("long"), lambda a, k: a + ((F.length(c) - F.length(F.replace(F.col(c), k, F.lit("")))) / F.length(k)).cast("long"))
    ok = (F.size("context_any") == 0) | F.exists("context_any", lambda k: F.contains(F.col("body"), k))
    return j.where(ok).select("doc_id", "topic", (6 * hits("title") + hits("body")).alias("score"), "minimum").where("score >= minimum").drop("minimum")


def relative_topk(df: DataFrame, by: str, score: str, key: str, floor: float, share: float, k: int) -> DataFrame:
    """SRT-04: rows of at least max(floor, share of the best), then the k first of each group."""
    best = Window.partitionBy(by)
    x = df.withColumn("best", F.max(score).over(best)).where(F.col(score) >= F.greatest(F.lit(floor), F.col("best") * share)).drop("best")
    return x.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), key))).where(F.col("rank") <= k)


def longest_non_overlapping(hits: DataFrame) -> DataFrame:
    """JON-10: of occurrences (key, start, end, term), drop those strictly inside a longer one of the same key."""
    # met through the places that a hit covers, so a key's hits aren't paired with each other
    o = hits.select("key", F.col("start").alias("os"), F.col("end").alias("oe"), F.explode(F.sequence("start", F.col("end") - 1)).alias("at"))
    inside = hits.withColumn("at", F.col("start")).join(o, ["key", "at"]).where("oe >= end and oe - os > end - start").select("key", "start", "end").distinct()
    return hits.join(inside, ["key", "start", "end"], "left_anti").select(*hits.columns)


def fuse(units: DataFrame) -> DataFrame:
    """RT-10, AGG-05: of (doc_id, unit, rank, tier, score), the best row of each document and its best rank."""
    order = F.struct(F.when(F.col("tier") == "direct", 0).otherwise(1), F.col("rank"), -F.col("score"), F.col("unit"))
    return units.groupBy("doc_id").agg(F.min("rank").alias("best_rank"), F.count("*").alias("n_units"), F.min_by("unit", order).alias("unit"), F.min_by("tier", order).alias("tier"))


def review_budget(df: DataFrame, eligible: Column, order: list, budget: int) -> DataFrame:
    """WIN-04: a running rank over eligible rows only; the first `budget` are to be reviewed."""
    ranked = numbered(df.where(eligible), order, "review_rank").withColumn("review_rank", F.col("review_rank") + 1)
    rest = df.where(~F.coalesce(eligible, F.lit(False))).withColumn("review_rank", F.lit(None).cast("long"))
    return ranked.select(*df.columns, "review_rank").union(rest).withColumn("in_budget", F.coalesce(F.col("review_rank") <= budget, F.lit(False)))


def page(df: DataFrame, order: list, offset: int, limit: int, cap: int) -> DataFrame:
    """SRT-05: positions of the first `cap` rows in order, one page of them.

    Only offset + limit rows are sorted together: a limit below the window keeps each task's first ones.
    """
    top = df.orderBy(*order).limit(min(cap, offset + limit + 1))
    pos = top.withColumn("pos", F.row_number().over(Window.orderBy(*order)))
    out = pos.where((F.col("pos") > offset) & (F.col("pos") <= min(cap, offset + limit)))
    return out


def two_pools(df: DataFrame, core: Column, order: list, core_limit: int, support_limit: int) -> DataFrame:
    """SRT-06: independent limits for two pools; what overflows is rejected with a reason."""
    x = df.withColumn("pool", F.when(core, "core").otherwise("support"))
    x = numbered(x.where("pool = 'core'"), order, "pool_rank").union(numbered(x.where("pool = 'support'"), order, "pool_rank"))
    x = x.withColumn("pool_rank", (F.col("pool_rank") + 1).cast("int"))
    limit = F.when(F.col("pool") == "core", core_limit).otherwise(support_limit)
    return x.withColumn("outcome", F.when(F.col("pool_rank") <= limit, "selected").otherwise(F.concat(F.col("pool"), F.lit("_limit"))))


def cosine_topk(vectors: DataFrame, queries: DataFrame, k: int, block: int = 2048) -> DataFrame:
    """RT-03: (query_id, vec_id, cosine, rank): of (id, v), the k rows of the largest cosine with each query, itself left out; ties to the smaller id.

    A block of vectors meets a block of queries as one matrix product and gives k rows a query, so what moves is a few
    rows a pair of blocks.  Vectors that are null, empty or of length zero take no part.
    """

    def blocks(df: DataFrame, tag: str) -> tuple[DataFrame, int]:
        df = df.where(F.size("v") > 0)
        n = max(1, -(-df.count() // block))
        return df.groupBy(F.pmod(F.xxhash64("id"), F.lit(n)).alias(f"{tag}b")).agg(F.collect_list("id").alias(f"{tag}i"), F.collect_list("v").alias(f"{tag}v")), n

    left, _ = blocks(vectors, "l")
    right, n = blocks(queries, "q")
    met = left.withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))).join(right, "qb").select("li", "lv", "qi", "qv")

    def best(batches):
        for batch in batches:
            for li, lv, qi, qv in batch.itertuples(index=False):
                a, b, ids = np.stack(lv).astype(float), np.stack(qv).astype(float), np.asarray(li)
                size = np.sqrt((b * b).sum(1))[:, None] * np.sqrt((a * a).sum(1))[None, :]
                cosine = np.divide(b @ a.T, size, out=np.full(size.shape, -np.inf), where=size > 0)
                cosine = np.round(np.where(np.asarray(qi)[:, None] == ids[None, :], -np.inf, cosine), 4)
                for row, q in zip(cosine, qi, strict=True):
                    top = np.lexsort((ids, -row))[:k]
                    top = top[np.isfinite(row[top])]
                    yield pd.DataFrame({"query_id": q, "vec_id": ids[top], "cosine": row[top]})

    found = met.mapInPandas(best, "query_id long, vec_id long, cosine double")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id"))).where(F.col("rank") <= k)
