"""Sinks (SNK-*): atomic tables, bundles behind a pointer, canonical JSON, idempotent batches."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """SNK-01: Spark's commit makes the rows appear together; `by` partitions the folders."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_bundle(spark: SparkSession, tables: dict[str, DataFrame], folder: str) -> str:
    """SNK-02: all tables into a new version, then one row that names it; readers see all or none.

    Versions are numbered after the last that is named; if a table fails nothing is named, and the last version stands.
    """
    version = uuid.uuid4().hex
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{version}/{name}")
    last = _versions(spark, folder).agg(F.max("n")).first()[0] or 0
    spark.createDataFrame([(version, last + 1)], "version string, n long").coalesce(1).write.mode("append").json(f"{folder}/_current")
    return version


def _versions(spark: SparkSession, folder: str) -> DataFrame:
    try:
        return spark.read.schema("version string, n long").json(f"{folder}/_current")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "version string, n long")


def read_bundle(spark: SparkSession, folder: str, name: str) -> DataFrame:
    version = _versions(spark, folder).orderBy(F.desc("n"), F.desc("version")).first()[0]
    return spark.read.parquet(f"{folder}/{version}/{name}")


def upsert_once(spark: SparkSession, path: str, key: str):
    """SNK-03: a foreachBatch function that writes each batch to a folder of its own, so a replay writes the same rows again; read by read_upserts()."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.dropDuplicates([key]).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def read_upserts(spark: SparkSession, path: str, key: str) -> DataFrame:
    """SNK-03: of each key the row of the last batch that has it."""
    x = spark.read.parquet(path)
    others = [c for c in x.columns if c not in (key, "batch")]
    return x.groupBy(key).agg(F.max_by(F.struct(*others), "batch").alias("r")).select(key, "r.*")


def canonical_json(*names: str) -> Column:
    """SNK-04: compact JSON with sorted keys."""
    return F.to_json(F.struct(*sorted(names)), {"ignoreNullFields": "false"})


def srt_lines(df: DataFrame, key: str, order: str, line: Column) -> DataFrame:
    """SNK-05/06/08: ordered lines of each key as one text."""
    lines = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l"))))
    return df.groupBy(key).agg(F.array_join(F.transform(lines, lambda x: x["l"]), "\n").alias("body"))
