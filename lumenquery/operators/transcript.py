"""WIN-01: what a dialogue says to a question: windows of +-REACH segments of the finalists, scored, the best that don't overlap.

Finalists of a question are the dialogues whose segments hold most of its terms by weight; they come from one pass of the terms'
automaton over all segments, so windows are only made of them.  A window's score is EXACT if it holds the whole question, plus the
weights of the terms that it holds, plus GRAMS times the share of the question's character grams that it has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenquery.functions import text as T

from . import automaton as A
from .topk import first_of
from .windows import context, greedy_windows

REACH, EXACT, GRAMS = 2, 100.0, 25.0


def finalists(segments: DataFrame, terms: DataFrame, k: int) -> DataFrame:
    """(question, key, weight): of (key, pos, body) and (question, term, weight), the k dialogues with the greatest weight of terms that one of their segments holds; ties to the smaller key."""
    hit = A.matches(segments, ["key"], "body", terms.select("term"), "count").select("key", "term").distinct()
    total = hit.join(terms, "term").groupBy("question", "key").agg(F.round(F.sum("weight"), 4).alias("weight"))
    return first_of(total, "question", [F.desc("weight"), "key"], k, "key").select("question", "key", "weight")


def windows(segments: DataFrame, chosen: DataFrame) -> DataFrame:
    """(question, key, w_start, w_end, window): the windows of the chosen dialogues, by places in the dialogue."""
    own = segments.join(chosen.select("key").distinct(), "key")
    own = own.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy("pos")) - 1)
    w = context(own, "key", "place", "body", REACH).select("key", "w_start", "w_end", F.replace(F.col("window"), F.lit(" "), F.lit("")).alias("window")).distinct()  # at the ends of a dialogue windows are the same
    return chosen.select("question", "key").join(w, "key").where("window <> ''")


def evidence(segments: DataFrame, questions: DataFrame, terms: DataFrame, k: int, limit: int) -> DataFrame:
    """(question, key, w_start, w_end, score, n_terms, exact, rank) of the best `limit` windows that don't overlap, of each finalist; segments: (key, pos, body), normalised; questions: (question, body)."""
    chosen = finalists(segments, terms, k)
    q = questions.select("question", F.col("body").alias("asked"), T.grams(F.col("body"), 2).alias("grams"))
    q = q.join(terms.groupBy("question").agg(F.collect_list(F.struct("term", "weight")).alias("terms")), "question", "left")
    w = windows(segments, chosen).join(q, "question")
    exact = (F.col("asked") != "") & F.contains("window", F.col("asked"))
    met = F.filter(F.coalesce("terms", F.array().cast("array<struct<term:string,weight:double>>")), lambda t: F.contains(F.col("window"), t["term"]))
    w = w.withColumn("exact", exact).withColumn("met", met).withColumn("shared", F.size(F.array_intersect("grams", T.grams(F.col("window"), 2))))
    w = w.where(F.col("exact") | (F.size("met") > 0) | (F.col("shared") >= 2))
    weight = F.aggregate("met", F.lit(0.0), lambda a, t: a + t["weight"])
    score = F.when(F.col("exact"), EXACT).otherwise(0.0) + weight + F.col("shared") / F.greatest(F.lit(1), F.size("grams")) * GRAMS
    w = w.select(F.concat_ws(":", "question", "key").alias("pair"), "question", "key", "w_start", "w_end", F.round(score, 4).alias("score"), F.size("met").alias("n_terms"), "exact")
    picked = greedy_windows(w, "pair", limit)
    rank = F.row_number().over(Window.partitionBy("question", "key").orderBy(F.desc("score"), "w_start", "w_end"))
    return picked.withColumn("rank", rank).drop("pair")
