"""Query plans, constraints, contracts, feedback and metrics (QU-*, EV-*, CT-*, FB-*, AGG-09..13, GV-*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Gains of primary and required results, and the claim match gate.
GAIN_PRIMARY, GAIN_REQUIRED, CLAIM_GATE, CLAIM_BAND = 2, 1, 0.34, 0.05


def expand_terms(questions: DataFrame, rules: DataFrame) -> DataFrame:
    """QU-03/04: (qid, term, weight) of (qid, text) by rules (query_term, suppress_term, expanded, weight, provenance).

    One-way: the rule's term is in the question and its suppressing term isn't; the largest weight of a term wins.
    """
    j = questions.join(F.broadcast(rules), F.contains("text", "query_term") & ~F.coalesce(F.contains("text", "suppress_term"), F.lit(False)))
    return j.groupBy("qid", F.col("expanded").alias("term")).agg(F.max("weight").alias("weight"), F.max_by("provenance", F.struct("weight", "provenance")).alias("provenance"))


def strategy(boundary: Column, systematic: Column, n_units: Column, diagnostic: Column) -> Column:
    """QU-06: the first that holds."""
    return F.when(boundary, "boundary").when(systematic, "systematic").when(n_units > 1, "multi_issue").when(diagnostic, "diagnostic").otherwise("focused")


def split_units(text: Column, separators: list[str]) -> Column:
    """QU-08, FN-17: units between separators, longest first; trimmed, empty ones dropped, first-seen order."""
    c = text
    for s in sorted(separators, key=lambda s: (-len(s), s)):
        c = F.replace(c, F.lit(s), F.lit("\x01"))
    return F.array_distinct(F.filter(F.transform(F.split(c, "\x01"), lambda u: F.trim(F.regexp_replace(u, r"^[\s.,;]+|[\s.,;]+$", ""))), lambda u: u != ""))


def constraint_match(requested: Column, found: Column, suppressed: Column) -> Column:
    """EV-02, K16: conflict, unspecified, partial, mixed or exact for arrays of axis values."""
    both = F.array_intersect(requested, found)
    return (
        F.when(F.arrays_overlap(requested, suppressed) & ~F.arrays_overlap(requested, found), "conflict")
        .when(F.size(found) == 0, "unspecified_support")
        .when(F.size(both) == 0, "conflict")
        .when(F.size(both) < F.size(requested), "partial_support")
        .when((F.size(requested) == 1) & (F.size(found) > 1), "mixed_support")
        .otherwise("exact")
    )


def first_reason(rules: dict[str, Column]) -> Column:
    """EV-09: the name of the first rule that rejects, else 'accepted'."""
    out = None
    for name, c in rules.items():
        out = F.when(c, name) if out is None else out.when(c, name)
    return out.otherwise("accepted")


def metrics(ranked: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """AGG-09, WIN-10: of ranked (case_id, item, rank) and gold (case_id, item, gain): found, expected, recall, reciprocal rank, nDCG at k."""
    ideal = gold.withColumn("i", F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("gain"), "item"))).where(F.col("i") <= k)
    ideal = ideal.groupBy("case_id").agg(F.sum(F.col("gain") / F.log2(F.col("i") + 1)).alias("idcg"))
    hit = ranked.where(F.col("rank") <= k).join(gold, ["case_id", "item"])
    per = hit.groupBy("case_id").agg(F.count("*").alias("found"), F.sum(F.col("gain") / F.log2(F.col("rank") + 1)).alias("dcg"), F.min(F.when(F.col("gain") == GAIN_PRIMARY, F.col("rank"))).alias("first_primary"))
    size = gold.groupBy("case_id").agg(F.count("*").alias("expected"))
    j = size.join(ideal, "case_id").join(per, "case_id", "left")
    return j.select("case_id", "expected", F.coalesce("found", F.lit(0)).alias("found"), F.round(F.coalesce(F.col("found"), F.lit(0)) / F.greatest(F.lit(1), F.col("expected")), 4).alias("recall"), F.round(F.coalesce(1 / F.col("first_primary"), F.lit(0.0)), 4).alias("reciprocal_rank"), F.round(F.coalesce(F.col("dcg"), F.lit(0.0)) / F.col("idcg"), 4).alias("ndcg"))


def compare_baseline(values: DataFrame, baseline: DataFrame) -> DataFrame:
    """FN-29, GV-01: (metric, value) against (metric, floor, direction, tolerance)."""
    j = baseline.join(values, "metric", "left")
    ok = F.when(F.col("direction") == "at_least", F.col("value") >= F.col("floor") - F.col("tolerance")).when(F.col("direction") == "at_most", F.col("value") <= F.col("floor") + F.col("tolerance")).otherwise(F.abs(F.col("value") - F.col("floor")) <= F.col("tolerance"))
    return j.select("metric", "value", F.when(F.col("value").isNull(), "missing").when(ok, "ok").otherwise("regression").alias("status"))


def violations(df: DataFrame, key: list[str], rules: dict[str, Column]) -> DataFrame:
    """CT-07: one row a broken rule; conditions that are null don't hold."""
    return df.select(*key, F.explode(F.array_compact(F.array(*[F.when(c, code) for code, c in rules.items()]))).alias("code"))
