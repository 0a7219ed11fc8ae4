"""Questions against evidence: coverage of concepts, decisions, contracts, layers of feedback (EV-*, CT-*, FB-*, JON-13/15/17/18, RT-06)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Concepts are words of this many letters or more.
CONCEPT = "([a-z]{7,})"
DECISIONS = ["exact_question", "exact_query_unit", "component", "expanded", "reviewed", "none"]


def concepts(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(CONCEPT), F.lit(1)))


def question_units(questions: DataFrame, key: str, text: str, ends: str) -> DataFrame:
    """QU-08: (key, unit, concept): unit 0 is the whole question, the others its sentences."""
    sentences = F.filter(F.split(F.lower(text), ends), lambda s: F.trim(s) != "")
    u = questions.select(key, F.posexplode(F.concat(F.array(F.lower(text)), sentences)).alias("unit", "t"))
    return u.select(key, "unit", F.explode(concepts(F.col("t"))).alias("concept"))


def matches(units: DataFrame, docs: DataFrame, key: str) -> DataFrame:
    """EV-05, EV-11: (key, unit, doc_id, matched, of, coverage, rank) by an equi join on concepts; rank by coverage within a unit.

    Documents are cut to the concepts that questions have before they are grouped; a question's common concept only
    costs its own rows.
    """
    size = units.groupBy(key, "unit").agg(F.count("*").alias("of"))
    words = docs.select("doc_id", F.explode(concepts(F.col("text"))).alias("concept"))
    m = words.join(units, "concept").groupBy(key, "unit", "doc_id").agg(F.count("*").alias("matched"))
    m = m.join(size, [key, "unit"]).withColumn("coverage", F.round(F.col("matched") / F.col("of"), 4))
    return m.withColumn("rank", F.rank().over(Window.partitionBy(key, "unit").orderBy(F.desc("coverage"), "doc_id")))


def match_flags() -> dict[str, Column]:
    """EV-05: thresholds on coverage and rank."""
    c, r = F.col("coverage"), F.col("rank")
    return {
        "full": F.col("matched") == F.col("of"), "direct": (c >= 0.8) | ((c >= 0.5) & (r <= 3)), "expansion": (c >= 0.5) & (r <= 8),
        "component": r <= 12, "substantive": F.col("matched") >= 2, "direct_question": (F.col("unit") == 0) & (F.col("matched") == F.col("of")),
    }


def concept_decision(m: DataFrame, reviewed: DataFrame, key: str) -> DataFrame:
    """EV-06: the best class of any match of (key, doc_id); reviewed: doc_ids."""
    f = match_flags()
    level = F.when(f["direct_question"], 0).when(f["full"], 1).when(f["component"] & f["substantive"], 2).when(f["expansion"], 3).otherwise(5)
    best = m.groupBy(key, "doc_id").agg(F.min(level).alias("level")).join(reviewed.select("doc_id", F.lit(4).alias("r")), "doc_id", "left")
    names = F.array(*map(F.lit, DECISIONS))
    return best.select(key, "doc_id", F.get(names, F.least("level", F.coalesce("r", F.lit(5)))).alias("decision"))


def focus(text: Column, groups: list[list[str]], phrases: list[str]) -> tuple[Column, Column]:
    """EV-07: how many groups have a term in the text once the phrases are taken out; whether all have."""
    for p in phrases:
        text = F.replace(text, F.lit(p), F.lit(" "))
    bound = F.transform(F.array(text), lambda t: sum((F.exists(F.array(*map(F.lit, g)), lambda x: F.contains(t, x)).cast("int") for g in groups), F.lit(0)))[0]
    return bound, bound == len(groups)


def prioritised(*sources: tuple[str, Column]) -> tuple[Column, Column]:
    """EV-01: the first array that isn't empty, and its source."""
    value, name = None, F
    for n, c in sources:
        some = F.when(F.size(c) > 0, c)
        value = some if value is None else F.coalesce(value, some)
        name = name.when(F.size(c) > 0, n)
    return F.coalesce(value, F.array().cast("array<string>")), name.otherwise("none")


def branches(evidence: DataFrame, key: str, required: list[str]) -> DataFrame:
    """CT-03: of (key, axis, value, item), the branches of axes that are required or have two values or more."""
    b = evidence.groupBy(key, "axis", "value").agg(F.countDistinct("item").alias("items"), F.min("item").alias("first"))
    n = F.count("*").over(Window.partitionBy(key, "axis"))
    return b.withColumn("n_values", n).where((F.col("n_values") >= 2) | F.col("axis").isin(required))


def digest(*names: str) -> Column:
    """CT-05: SHA-256 over canonical JSON of the columns."""
    return F.sha2(F.to_json(F.struct(*sorted(names)), {"ignoreNullFields": "false"}).cast("binary"), 256)


def top_evidence(claims: DataFrame, evidence: DataFrame, on: str, key: list[str], rank: list, k: int) -> DataFrame:
    """JON-17, WIN-09: the k best rows of evidence for each claim."""
    j = claims.join(evidence, on)
    return j.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy(*rank))).where(F.col("place") <= k)


def scoped(atoms: DataFrame, claims: DataFrame, on: list[str], need: str, have: str) -> DataFrame:
    """JON-18: an equi join where the atom's scope is a subset of the claim's constraints."""
    return atoms.join(claims, on).where(F.size(F.array_except(need, have)) == 0)


def adjustments(signals: DataFrame, key: str, bound: float) -> DataFrame:
    """AGG-04: of (key, signal, similarity, weight): the clamped sum, its positive and negative parts, the largest similarity, how many signals."""
    v = F.col("similarity") * F.col("weight")
    s = signals.groupBy(key).agg(F.sum(v).alias("s"), F.sum(F.when(v > 0, v).otherwise(0.0)).alias("p"), F.sum(F.when(v < 0, -v).otherwise(0.0)).alias("n"), F.max("similarity").alias("max_similarity"), F.countDistinct("signal").alias("signals"))
    return s.select(key, F.round(F.greatest(F.lit(-bound), F.least(F.lit(bound), "s")), 4).alias("delta"), F.round("p", 4).alias("positive"), F.round("n", 4).alias("negative"), F.round("max_similarity", 4).alias("max_similarity"), "signals")


def layered(ranked: DataFrame, layers: dict[str, DataFrame], eligible: DataFrame, key: str, promote: float) -> DataFrame:
    """JON-13, RT-06: adjustments of several layers meet the ranked rows; what only they name comes in if it is eligible and they raise it; a near-certain one is direct."""
    total = None
    for name, df in layers.items():
        part = df.select(key, F.col("delta").alias(f"delta_{name}"), F.col("max_similarity").alias(f"sim_{name}"))
        total = part if total is None else total.join(part, key, "full")
    delta = sum((F.coalesce(f"delta_{n}", F.lit(0.0)) for n in layers), F.lit(0.0))
    sim = F.greatest(*[F.coalesce(f"sim_{n}", F.lit(0.0)) for n in layers], F.lit(0.0))
    total = total.select(key, F.round(delta, 4).alias("delta"), sim.alias("sim"))
    j = ranked.join(total, key, "full").join(eligible.select(key, F.lit(True).alias("ok")), key, "left")
    j = j.where(F.col("tier").isNotNull() | ((F.col("delta") > 0) & F.col("ok")))
    tier = F.when((F.col("sim") >= promote) & (F.col("delta") > 0), "direct").otherwise(F.coalesce("tier", F.lit("feedback_only")))
    return j.select(key, tier.alias("tier"), F.round(F.coalesce("score", F.lit(0.0)) + F.coalesce("delta", F.lit(0.0)), 4).alias("score"), F.col("score").isNull().alias("injected"))
