"""A corpus pipeline of five stages, each one of the operators of lumenquery.llm.

Every stage takes (spark, docs, sf_dir) and all rows that its predecessor kept;
all but the last return the columns of documents.  Results of a stage are
written to the shared folder and read again as the next one's docs.

Nulls, empty tables, repeated rows and columns of any further name are treated as each operator's docstring says: null and
blank texts fail the quality rules; rows of one doc_id stay apart unless their texts are near copies; an empty table gives
none; further columns pass through every stage but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenquery.llm import op1_secrets, op2_quality, op4_mixing, op7_sentencepiece, op8_jaccard
from lumenquery.llm.common import materialize

#: Near duplicates: words a shingle, and the least similarity in percent.
SHINGLE, PERCENT = 5, 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the model reject go."""
    return op2_quality.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return op8_jaccard.keep_one(docs, SHINGLE, PERCENT)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; documents stay."""
    return op1_secrets.redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled by the probabilities that meet the target weights."""
    return op4_mixing.sample(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts become piece ids."""
    return op7_sentencepiece.encode(docs, keep=("doc_id", "lang", "source"))


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("secret scans", secret_scans),
    ("mixing", mixing),
    ("sentencepiece", sentencepiece),
]

#: A fitted model and a Viterbi fold are among the stages, which SQL doesn't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
