"""What an answer may say to every benchmark item, the packet that carries it, and the audit of answers (CT-01, CT-04, CT-06, CT-07)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenquery.operators import answers as A
from lumenquery.operators import audit as U
from lumenquery.sources.tables import table

from .text_queries import NORM
from .topk_queries import ORACLES as TOPK
from .topk_queries import search_topk

SELECTED = 3
PROMPT = "Was this useful?"


def _context(spark, d):
    """The questions, and what is selected, rejected and claimed for each; all questions share the search."""
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("question"), "text")
    found = search_topk(spark, d)
    ids = F.broadcast(found.select("doc_id").distinct())  # of TOP documents a question: no other text or label moves
    labels = table(spark, d, "labels").join(ids, "doc_id", "left_semi").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    docs = table(spark, d, "documents").select("doc_id", "text").join(ids, "doc_id", "left_semi").join(labels, "doc_id", "left")
    reason = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low_quality")
    selected, rejected = A.select(found, docs, reason, SELECTED)
    selected = selected.checkpoint()
    return q, selected, rejected, A.claims(q, selected).checkpoint()


def answer_context(spark, d):
    """CT-01: the claims of every question with the documents that support them."""
    q, selected, _, claims = _context(spark, d)
    n = selected.groupBy("question").agg(F.array_join(F.array_sort(F.collect_list("evidence_id")), ",").alias("selected"))
    return claims.join(n, "question", "left").select("question", "claim_id", "status", "ceiling", F.array_join("labels", ",").alias("labels"), F.array_join("weak_labels", ",").alias("weak_labels"), "selected")


def answer_rejections(spark, d):
    """CT-01, EV-09: why found documents weren't selected."""
    return _context(spark, d)[2].groupBy("question", "reason").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


def answer_packet(spark, d):
    """CT-06: packets of all questions, made, changed in one question of five, and held against their contexts: what is wrong, and how much smaller they are."""
    made = A.contexts(*_context(spark, d)).checkpoint()
    packets = made.select("question", A.packet(F.col("context")).alias("packet"))
    sizes = made.select("question", F.octet_length(F.to_json("context")).alias("whole")).join(packets.select("question", F.octet_length(F.to_json("packet")).alias("small")), "question")
    sent = packets.withColumn("packet", F.when(F.col("question") % 5 == 4, F.col("packet").withField("query", F.concat("packet.query", F.lit(" ")))).otherwise(F.col("packet")))
    return A.checked(sent, made).join(sizes, "question").select("question", "problem", (1 - F.col("small") / F.col("whole") >= 0.45).alias("small_enough"))


def _answers(spark, d):
    """An answer to every question from its own context: each claim with its first document and its mark; every other question's answer has a fault."""
    q, selected, _, claims = _context(spark, d)
    c = claims.withColumn("label", F.get(F.concat("labels", "weak_labels"), F.lit(0))).join(selected.select("question", "label", "evidence_id", "url"), ["question", "label"], "left")
    open_ = F.col("status") != "supported"
    words = F.concat(F.when(open_, "It may be that ").otherwise(F.when(F.col("question") % 4 == 1, "Definitely ").otherwise("")), F.col("text"))
    c = c.withColumn("again", F.row_number().over(Window.partitionBy("question", "label").orderBy("claim_id")) > 1)
    cite = F.concat_ws(" ", "label", F.concat(F.lit("("), "evidence_id", F.lit(")")), F.when(~F.col("again"), F.col("url")))  # a document's address stands once
    line = F.concat_ws(" ", words, F.when(F.col("label").isNotNull(), cite), F.concat(F.lit("["), "claim_id", F.lit("]")))
    n = F.substring("claim_id", 2, 9).cast("int")
    text = c.groupBy("question").agg(F.array_sort(F.collect_list(F.struct(n.alias("n"), line.alias("l")))).alias("lines"))
    end = F.when(F.col("question") % 4 == 2, "See V9").when(F.col("question") % 4 == 3, "Bye").otherwise(PROMPT)
    text = text.select("question", F.concat(F.array_join(F.transform("lines", lambda x: x["l"]), "\n"), F.lit("\n"), end).alias("answer"))
    answers = q.join(text, "question").select(F.col("question").alias("answer_id"), "question", F.col("text").alias("asked"), F.col("answer").alias("text"))
    nothing = F.array().cast("array<struct<id:string,question:string,answer:string>>")
    turns = q.select("question", F.col("text").alias("query"), F.lit(PROMPT).alias("prompt"), F.lit("").alias("statement"), F.lit(False).alias("one_cause"), F.array().cast("array<string>").alias("errors"), nothing.alias("resolved"), nothing.alias("pending"))
    made = claims.select("question", "claim_id", F.lit("answer").alias("kind"), "status", "ceiling", "text", F.array_union("labels", "weak_labels").alias("labels"), F.col("weak_labels").alias("limited"))
    return answers, turns, selected.select("question", "label", "evidence_id", "url"), made, made.select("question", F.col("claim_id").alias("item_id"), "status", "text")


def answer_audit(spark, d):
    """CT-07: what the answers to all questions break, by code."""
    return U.audit(*_answers(spark, d)).groupBy("answer_id", "code").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("claim_id")), ",").alias("claims"))


QUERIES = {f.__name__: f for f in (answer_context, answer_rejections, answer_packet, answer_audit)}

_G = "list_distinct(list_transform(range(1, length({0}) - 2), lambda i: substr({0}, i, 4)))"
_CTX = f"""WITH tk AS ({TOPK['search_topk']}), lb AS (SELECT doc_id, max(toxic) AS toxic, min(quality) AS quality FROM labels GROUP BY 1),
j AS (SELECT question, rank, tk.doc_id, text, CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 0 THEN 'low_quality' END AS reason FROM tk JOIN documents USING (doc_id) LEFT JOIN lb ON lb.doc_id = tk.doc_id),
ok AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY rank) AS n FROM j WHERE reason IS NULL), sel AS (SELECT question, 'V' || n AS label, doc_id, 'doc-' || doc_id AS evidence_id, {NORM.format('text')} AS t FROM ok WHERE n <= 3),
rej AS (SELECT question, doc_id, reason FROM j WHERE reason IS NOT NULL UNION ALL SELECT question, doc_id, 'beyond_limit' FROM ok WHERE n > 3),
pt AS (SELECT item_id AS question, trim(u.p) AS text, min(u.o) AS o FROM benchmark, unnest(regexp_split_to_array(text, '[.!?\\n]+')) WITH ORDINALITY u(p, o) WHERE trim(u.p) <> '' GROUP BY 1, 2),
cl AS (SELECT question, 'C' || row_number() OVER (PARTITION BY question ORDER BY o) AS claim_id, text, {NORM.format('text')} AS t FROM pt), cg AS (SELECT question, claim_id, {_G.format('t')} AS g FROM cl), dg AS (SELECT question, label, {_G.format('t')} AS g FROM sel),
sh AS (SELECT cg.question, claim_id, label, len(list_intersect(cg.g, dg.g)) / greatest(1, len(cg.g)) AS share FROM cg JOIN dg ON dg.question = cg.question),
lbs AS (SELECT cg.question, cg.claim_id, coalesce(list_sort(list(label) FILTER (WHERE share >= 0.9)), []) AS labels, coalesce(list_sort(list(label) FILTER (WHERE share >= 0.5 AND share < 0.9)), []) AS weak FROM cg LEFT JOIN sh ON sh.question = cg.question AND sh.claim_id = cg.claim_id GROUP BY 1, 2),
ctx AS (SELECT question, claim_id, CASE WHEN len(labels) > 0 THEN 'supported' WHEN len(weak) > 0 THEN 'conditional' ELSE 'unresolved' END AS status, CASE WHEN len(labels) > 1 THEN 'high' WHEN len(labels) = 1 THEN 'medium' WHEN len(weak) > 0 THEN 'low' ELSE 'none' END AS ceiling,
array_to_string(labels, ',') AS labels, array_to_string(weak, ',') AS weak_labels FROM lbs)"""

ORACLES = {
    "answer_context": f"{_CTX}, s AS (SELECT question, array_to_string(list_sort(list(evidence_id)), ',') AS selected FROM sel GROUP BY 1) SELECT ctx.*, selected FROM ctx LEFT JOIN s USING (question)",
    "answer_rejections": f"{_CTX} SELECT question, reason, count(*) AS n, min(doc_id) AS first FROM rej GROUP BY 1, 2",
}
