"""Notes and atoms (SRC-06, MSC-17)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lumenquery.operators import notes as N
from lumenquery.sources.journal import Journal
from lumenquery.sources.stored import shared_folder
from lumenquery.sources.tables import table


def review_notes_upsert(spark, d):
    """SRC-06: all labels as Markdown notes, read back and upserted; then notes of toxic documents with a reason, which replace theirs; then the same files again."""
    f = f"{shared_folder(spark)}/notes-{uuid.uuid4().hex}"
    labels = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    key = F.concat(F.lit("doc-"), "doc_id")
    labels.select(N.section(key, {"quality": F.col("quality"), "toxic": F.col("toxic")}).alias("value")).write.text(f"{f}/first")
    labels.where("toxic = 1").select(N.section(key, {"quality": F.lit(0), "reason": F.lit("toxic")}).alias("value")).write.text(f"{f}/second")
    j = Journal(spark, f"{f}/store")
    for part in ("first", "second", "second"):
        N.upsert(j, N.scan(spark, f"{f}/{part}"))
    of = lambda n: F.element_at("fields", n)
    return N.current(j).select("key", of("quality").alias("quality"), of("toxic").alias("toxic"), of("reason").alias("reason"), "batch")


def evidence_atoms(spark, d):
    """MSC-17: documents as atoms, those of one text as a group."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("atom_id"), "source", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("h"))
    groups = docs.groupBy("h").agg(F.count("*").alias("n"), F.collect_list("atom_id").alias("members")).where("n between 2 and 50").select("members")
    return N.grouped_atoms(docs.drop("h"), groups)


QUERIES = {f.__name__: f for f in (review_notes_upsert, evidence_atoms)}

ORACLES = {
    "review_notes_upsert": """WITH l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1)
SELECT 'doc-' || doc_id AS key, CASE WHEN toxic = 1 THEN '0' ELSE CAST(quality AS VARCHAR) END AS quality, CASE WHEN toxic = 1 THEN NULL ELSE CAST(toxic AS VARCHAR) END AS toxic, CASE WHEN toxic = 1 THEN 'toxic' END AS reason, CAST(CASE WHEN toxic = 1 THEN 2 ELSE 1 END AS BIGINT) AS batch FROM l""",
    "evidence_atoms": """WITH h AS (SELECT doc_id, source, sha256(coalesce(text, '')) AS h FROM documents), g AS (SELECT h, min(doc_id) AS m FROM h GROUP BY 1 HAVING count(*) BETWEEN 2 AND 50)
SELECT doc_id AS atom_id, source, coalesce(m, doc_id) AS group_id FROM h LEFT JOIN g USING (h)""",
}
