"""CT-07/08: what an answer breaks of its context, over all answers at once: units x claims, one row a violation.

Inputs, all keyed by question but the answers; a question's context is small (some claims, some documents), so its joins are bounded by the answers.

    answers   (answer_id, question, asked, text)
    turns     (question, query, prompt, statement, one_cause, errors, resolved, pending)
              query: what the context was made for; prompt: how an answer ends; statement: a boundary that it has to tell; one_cause: it may not
              name a single cause; errors: what is wrong with the turn's own contract; resolved: (id, question, answer); pending: (id, question)
    selected  (question, label, evidence_id, url)
    claims    (question, claim_id, kind, status, ceiling, text, labels, limited)   limited: labels whose evidence is of limited scope
    items     (question, item_id, status, text)

A unit is a line.  It states the claims that it marks, [C1], else those whose character grams it holds to MATCH, within BAND of its best.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenquery.functions import text as T

MATCH, BAND, RESOLVED, REASKED, REQUIRED, BOUNDARY, EXCERPT, GRAM = 0.34, 0.05, 0.5, 0.9, 0.6, 0.6, 240, 4

#: The codes.
CODES = (
    "missing_feedback_prompt",
    "invalid_clarification_contract",
    "answer_turn_evidence_state_mismatch",
    "question_context_mismatch",
    "unmapped_video_label",
    "unmapped_evidence_id",
    "citation_claim_mismatch",
    "unsupported_causal_certainty",
    "confidence_ceiling_exceeded",
    "evidence_scope_overreach",
    "citation_evidence_id_mismatch",
    "missing_completeness_item",
    "conditionality_lost",
    "missing_claim_citation",
    "missing_unique_cause_boundary",
    "missing_resolved_clarification",
    "resolved_clarification_reasked",
    "missing_required_clarification",
    "missing_required_boundary",
    "missing_citation_evidence_id",
    "missing_citation_url",
    "duplicate_citation_url",
)


@dataclass(frozen=True)
class Rules:
    label: str = r"\b(V[0-9]+)\b"
    evidence: str = r"\b(doc-[0-9]+)\b"
    marker: str = r"\[(C[0-9]+|B[0-9]+)\]"
    conditional: tuple[str, ...] = ("if", "when", "may", "might")
    uncertain: tuple[str, ...] = ("perhaps", "unclear", "not known")
    certain: tuple[str, ...] = ("definitely", "certainly", "proven")
    universal: tuple[str, ...] = ("always", "everyone", "never")
    one_cause: str = "cannot be told from this alone"


def _any(c: Column, terms: tuple[str, ...]) -> Column:
    return c.rlike(r"(?i)\b(" + "|".join(map(re.escape, terms)) + r")\b")


def _of(c: Column, pattern: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)))


def held(needle: Column, hay: Column) -> Column:
    """SET-07: how much of a text another one holds: all of it, or the share of its character grams; 0 if either is blank."""
    a, b = T.norm(needle), T.norm(hay)
    share = F.size(F.array_intersect(T.grams(a, GRAM), T.grams(b, GRAM))) / F.greatest(F.lit(1), F.size(T.grams(a, GRAM)))
    return F.when((a == "") | (b == "") | a.isNull() | b.isNull(), 0.0).when(F.contains(b, a), 1.0).otherwise(share)


def units(answers: DataFrame, turns: DataFrame, rules: Rules) -> tuple[DataFrame, DataFrame]:
    """Answers without their closing prompt, with what they cite, and their lines (answer_id, question, n, unit, labels, ids)."""
    a = answers.join(turns, "question", "left")
    ends = F.endswith(F.rtrim("text"), F.col("prompt"))
    body = F.when(ends, F.rtrim(F.expr("left(rtrim(text), length(rtrim(text)) - length(prompt))"))).otherwise(F.col("text"))
    a = a.withColumn("ends", F.coalesce(ends, F.lit(True))).withColumn("body", body).withColumn("labels", _of(F.col("body"), rules.label)).withColumn("ids", _of(F.col("body"), rules.evidence))
    lines = F.filter(F.transform(F.split("body", r"\n+"), lambda s: F.trim(s)), lambda s: s != "")
    u = a.select("answer_id", "question", F.posexplode(lines).alias("n", "unit"))
    bare = F.regexp_replace("unit", r"https?://\S+", "")
    return a, u.select("*", _of(F.col("unit"), rules.label).alias("labels"), _of(bare, rules.evidence).alias("ids"))


def stated(u: DataFrame, claims: DataFrame, rules: Rules) -> DataFrame:
    """Units with the claims that they state: the columns of both."""
    marks = _of(F.col("unit"), rules.marker)
    j = u.withColumn("marks", marks).join(claims.withColumnRenamed("labels", "eligible").withColumnRenamed("text", "claim"), "question")
    score = F.when(F.size("marks") > 0, F.array_contains("marks", F.col("claim_id")).cast("double")).otherwise(held(F.col("claim"), F.col("unit")))
    j = j.withColumn("match", score).withColumn("best", F.max("match").over(Window.partitionBy("answer_id", "n")))
    return j.where((F.col("match") >= MATCH) & (F.col("match") >= F.col("best") - BAND))


def audit(answers: DataFrame, turns: DataFrame, selected: DataFrame, claims: DataFrame, items: DataFrame, rules: Rules | None = None) -> DataFrame:
    """(answer_id, code, claim_id, unit, detail), each once."""
    rules = rules or Rules()
    a, u = units(answers, turns, rules)
    a, u = a.checkpoint(), u.checkpoint()
    of_claims = stated(u, claims, rules).checkpoint()
    none = F.lit("")
    out: list[DataFrame] = []

    def tell(df: DataFrame, code: str, when: Column, claim: Column = none, unit: Column = none, detail: Column = none) -> None:
        out.append(df.where(F.coalesce(when, F.lit(False))).select("answer_id", F.lit(CODES[CODES.index(code)]).alias("code"), claim.alias("claim_id"), F.substring(unit, 1, EXCERPT).alias("unit"), detail.alias("detail")))

    errors = F.coalesce("errors", F.array(F.lit("no_turn")))
    tell(a, "missing_feedback_prompt", ~F.col("ends"))
    tell(a, "invalid_clarification_contract", F.size(errors) > 0, detail=F.array_join(errors, ","))
    tell(a, "answer_turn_evidence_state_mismatch", F.exists(errors, lambda e: F.contains(e, F.lit("evidence_state"))))
    tell(a, "question_context_mismatch", T.norm(F.coalesce("query", F.lit(""))) != T.norm(F.col("asked")))

    # what the answer cites, against what was selected for its question
    named = a.select("answer_id", "question", "body", F.explode("labels").alias("label")).join(selected, ["question", "label"], "left")
    tell(named, "unmapped_video_label", F.col("evidence_id").isNull(), detail=F.col("label"))
    ids = a.select("answer_id", "question", F.explode("ids").alias("evidence_id")).join(selected, ["question", "evidence_id"], "left")
    tell(ids, "unmapped_evidence_id", F.col("label").isNull(), detail=F.col("evidence_id"))
    bare = F.regexp_replace("body", r"https?://\S+", "")
    times = (F.length("body") - F.length(F.replace(F.col("body"), F.col("url"), F.lit("")))) / F.length("url")
    tell(named, "missing_citation_evidence_id", ~F.contains(bare, F.col("evidence_id")), detail=F.col("label"))
    tell(named, "missing_citation_url", ~F.contains("body", F.col("url")), detail=F.col("label"))
    tell(named, "duplicate_citation_url", times > 1, detail=F.col("label"))
    known = selected.groupBy("question").agg(F.collect_list("label").alias("all_labels"), F.collect_list("evidence_id").alias("all_ids"))
    cited = u.join(known, "question").withColumn("other", F.array_intersect("ids", "all_ids")).select("*", F.explode("labels").alias("label")).join(selected.select("question", "label", "evidence_id"), ["question", "label"])
    tell(cited, "citation_evidence_id_mismatch", (F.size("other") > 0) & ~F.array_contains("other", F.col("evidence_id")), unit=F.col("unit"), detail=F.col("label"))

    # what a unit states of a claim
    c = of_claims.join(known, "question", "left").withColumn("mapped", F.array_intersect("labels", F.coalesce("all_labels", F.array().cast("array<string>"))))
    at = {"claim": F.col("claim_id"), "unit": F.col("unit")}
    tell(c, "citation_claim_mismatch", F.size(F.array_except("mapped", "eligible")) > 0, **at, detail=F.array_join(F.array_sort(F.array_except("mapped", "eligible")), ","))
    guess = (F.col("kind") == "user_hypothesis") & F.col("status").isin("unverified", "conditional")
    certain, unsure = _any(F.col("unit"), rules.certain), _any(F.col("unit"), rules.uncertain)
    tell(c, "unsupported_causal_certainty", guess & certain & ~unsure, **at)
    sure = ~guess & F.col("status").isin("supported", "conditional")
    strength = F.when(certain, 3).when(_any(F.col("unit"), rules.conditional), 1).otherwise(2)
    ceiling = F.when(F.col("ceiling") == "high", 3).when(F.col("ceiling") == "medium", 2).when(F.col("ceiling") == "low", 1).otherwise(0)
    tell(c, "confidence_ceiling_exceeded", sure & (strength > ceiling), **at, detail=F.col("ceiling"))
    used = F.array_intersect("labels", "eligible")
    tell(c, "evidence_scope_overreach", sure & (F.size(used) > 0) & (F.size(F.array_except(used, F.col("limited"))) == 0) & _any(F.col("unit"), rules.universal), **at)

    # what the answer has to cover
    i = a.select("answer_id", "question").join(items, "question")
    marked = F.array_contains(_of(F.col("unit"), rules.marker), F.col("item_id"))
    seen = i.join(u.select("answer_id", "n", "unit", "labels"), "answer_id").withColumn("marked", marked).withColumn("any_marked", F.max("marked").over(Window.partitionBy("answer_id", "item_id")))
    covered = seen.where(F.col("marked") | (~F.col("any_marked") & (held(F.col("text"), F.col("unit")) >= MATCH)))
    qualified = _any(F.col("unit"), rules.conditional) | _any(F.col("unit"), rules.uncertain)
    per = covered.groupBy("answer_id", "item_id").agg(F.max(qualified).alias("qualified"), F.min_by("unit", "n").alias("unit"), F.array_distinct(F.flatten(F.collect_list("labels"))).alias("cited"))
    x = i.join(per, ["answer_id", "item_id"], "left").join(claims.select("question", F.col("claim_id").alias("item_id"), F.col("labels").alias("eligible"), F.col("status").alias("claim_status")), ["question", "item_id"], "left")
    there, item = F.col("unit").isNotNull(), F.col("item_id")
    tell(x, "missing_completeness_item", ~there, claim=item)
    tell(x, "conditionality_lost", there & F.col("status").isin("conditional", "unresolved") & ~F.col("qualified"), claim=item, unit=F.coalesce("unit", none))
    backed = (F.size("eligible") > 0) & F.col("claim_status").isin("supported", "conditional")
    tell(x, "missing_claim_citation", there & backed & ~F.arrays_overlap("cited", "eligible"), claim=item)

    # what the turn asks for
    tell(a, "missing_unique_cause_boundary", F.col("one_cause") & ~F.contains(F.lower("body"), F.lit(rules.one_cause)))
    tell(a, "missing_required_boundary", (F.coalesce("statement", none) != "") & (held(F.col("statement"), F.col("body")) < BOUNDARY))
    right = a.where(F.size(errors) == 0)
    done = right.select("answer_id", "body", F.explode("resolved").alias("r"))
    tell(done, "missing_resolved_clarification", held(F.col("r.answer"), F.col("body")) < RESOLVED, detail=F.col("r.id"))
    tell(done, "resolved_clarification_reasked", held(F.col("r.question"), F.col("body")) >= REASKED, detail=F.col("r.id"))
    open_ = right.select("answer_id", "body", F.explode("pending").alias("r"))
    tell(open_, "missing_required_clarification", held(F.col("r.question"), F.col("body")) < REQUIRED, detail=F.col("r.id"))
    return reduce(DataFrame.union, out).distinct()
