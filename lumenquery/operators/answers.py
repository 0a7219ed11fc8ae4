"""CT-01, CT-04, CT-06: what an answer may say, for all questions at once, and the packet that carries it.

A context is a few small tables keyed by question, so that any number of questions shares every scan:

    selected  (question, label, doc_id, evidence_id, url, score, text)     the first eligible documents of the search, V1, V2, ...
    rejected  (question, doc_id, reason)
    claims    (question, claim_id, text, status, ceiling, labels, weak_labels)   the question's sentences, and the labels whose documents hold them

A claim is supported by a label if the document holds SUPPORTED of its character grams, weakly from WEAK on; status and ceiling follow from
the labels.  The packet is the context with excerpts in place of texts, the documents named once in a dictionary, and the digest of the whole context's
canonical JSON; it is valid if it equals the packet that the context gives again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenquery.functions import text as T

GRAM, SUPPORTED, WEAK, EXCERPT = 4, 0.9, 0.5, 160


def select(found: DataFrame, docs: DataFrame, reason: Column, k: int) -> tuple[DataFrame, DataFrame]:
    """Of a search's (question, rank, doc_id, score) the k first that have no reason against them, and the others with theirs; docs: (doc_id, text, what `reason` reads)."""
    j = found.join(docs, "doc_id").withColumn("reason", reason)
    ok = j.where("reason is null").withColumn("n", F.row_number().over(Window.partitionBy("question").orderBy("rank")))
    label, evidence = F.concat(F.lit("V"), F.col("n")), F.concat(F.lit("doc-"), F.col("doc_id"))
    first = ok.where(F.col("n") <= k).select("question", label.alias("label"), "doc_id", evidence.alias("evidence_id"), F.concat(F.lit("https://docs.example/"), F.col("doc_id")).alias("url"), "score", "text")
    late = ok.where(F.col("n") > k).select("question", "doc_id", F.lit("beyond_limit").alias("reason"))
    return first, j.where("reason is not null").select("question", "doc_id", "reason").union(late)


def claims(questions: DataFrame, selected: DataFrame) -> DataFrame:
    """The sentences of each question (question, text), C1, C2, ..., with the labels that support them."""
    parts = F.array_distinct(F.filter(F.transform(F.split("text", r"[.!?\n]+"), lambda s: F.trim(s)), lambda s: s != ""))
    c = questions.select("question", F.posexplode(parts).alias("n", "text")).select("question", F.concat(F.lit("C"), F.col("n") + 1).alias("claim_id"), "text")
    grams = lambda x: T.grams(T.norm(F.col(x)), GRAM)
    c = c.withColumn("grams", grams("text"))
    docs = selected.select("question", "label", grams("text").alias("of_doc"))
    met = c.select("question", "claim_id", "grams").join(docs, "question")
    share = F.size(F.array_intersect("grams", "of_doc")) / F.greatest(F.lit(1), F.size("grams"))
    per = met.withColumn("share", share).groupBy("question", "claim_id").agg(*[F.array_sort(F.collect_list(F.when(ok, F.col("label")))).alias(n) for n, ok in (("labels", F.col("share") >= SUPPORTED), ("weak_labels", (F.col("share") >= WEAK) & (F.col("share") < SUPPORTED)))])
    none = F.array().cast("array<string>")
    x = c.drop("grams").join(per, ["question", "claim_id"], "left").withColumns({n: F.coalesce(n, none) for n in ("labels", "weak_labels")})
    status = F.when(F.size("labels") > 0, "supported").when(F.size("weak_labels") > 0, "conditional").otherwise("unresolved")
    ceiling = F.when(F.size("labels") > 1, "high").when(F.size("labels") == 1, "medium").when(F.size("weak_labels") > 0, "low").otherwise("none")
    return x.select("question", "claim_id", "text", status.alias("status"), ceiling.alias("ceiling"), "labels", "weak_labels")


def contexts(questions: DataFrame, selected: DataFrame, rejected: DataFrame, made: DataFrame) -> DataFrame:
    """(question, context): one nested row a question."""
    rows = lambda df, name, *cols: df.groupBy("question").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))
    x = questions.select("question", F.col("text").alias("query"))
    for part in (rows(selected, "selected", "label", "evidence_id", "url", "score", "text"), rows(rejected, "rejected", "doc_id", "reason"), rows(made, "claims", "claim_id", "text", "status", "ceiling", "labels", "weak_labels")):
        x = x.join(part, "question", "left")
    return x.select("question", F.struct("query", "selected", "rejected", "claims").alias("context"))


def packet(context: Column) -> Column:
    """The compact projection, and the digest of what it projects."""
    excerpt = F.transform(context["selected"], lambda s: F.struct(s["label"].alias("label"), s["evidence_id"].alias("evidence_id"), s["url"].alias("url"), T.shorten(s["text"], EXCERPT).alias("excerpt")))
    of = F.transform(context["claims"], lambda c: F.struct(c["claim_id"].alias("claim_id"), c["text"].alias("text"), c["status"].alias("status"), c["ceiling"].alias("ceiling"), F.array_union(c["labels"], c["weak_labels"]).alias("labels")))
    return F.struct(F.sha2(F.to_json(context).cast("binary"), 256).alias("digest"), context["query"].alias("query"), excerpt.alias("evidence"), of.alias("claims"))


def checked(packets: DataFrame, made: DataFrame) -> DataFrame:
    """(question, problem): of packets (question, packet) against contexts: null, 'no_context', 'digest' or 'projection'."""
    j = packets.join(made.select("question", "context", packet(F.col("context")).alias("again")), "question", "left")
    problem = F.when(F.col("context").isNull(), "no_context").when(F.col("packet.digest") != F.col("again.digest"), "digest").when(F.to_json("packet") != F.to_json("again"), "projection")
    return j.select("question", problem.alias("problem"))


def supports_scope(claims_of: DataFrame, scope: Column) -> DataFrame:
    """CT-04: (question, supported): whether one of a question's supported claims falls within the scope that it asks for."""
    return claims_of.groupBy("question").agg(F.max((F.col("status") == "supported") & scope).alias("supported"))
