"""Scans (SRC-*): tables by name, nested JSON, corrupt rows kept aside, section documents, file fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nested_json(spark: SparkSession, path: str, schema: str, rows: str) -> DataFrame:
    """SRC-01: one document a file; the rows of one of its arrays."""
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode(rows).alias("r")).select("r.*")


def json_directory(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC-02/03: all JSON files below a folder; what can't be parsed is in _corrupt; file stem as key."""
    out = spark.read.schema(f"{schema}, _corrupt string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("recursiveFileLookup", True).json(path)
    return out.withColumn("file_key", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.json$", 1))


def shape_tolerant(df: DataFrame, arrays: list[str], key: str) -> DataFrame:
    """SRC-04: the first array that is there, exploded; rows without a key and later repeats of one go."""
    rows = df.select(F.posexplode(F.coalesce(*map(F.col, arrays))).alias("pos", "r")).select("pos", "r.*").where(F.col(key).isNotNull() & (F.col(key) != ""))
    return rows.groupBy(key).agg(F.min_by(F.struct(*[c for c in rows.columns if c not in (key, "pos")]), "pos").alias("r")).select(key, "r.*")


def sections(text: F.Column, heading: str = "### ") -> F.Column:
    """SRC-05/07: map of heading to the trimmed text below it; placeholders become empty."""
    parts = F.slice(F.split(F.concat(F.lit("\n"), text), "\n" + heading), 2, 1_000_000)
    pair = lambda p: F.struct(F.trim(F.split(p, "\n", 2)[0]).alias("k"), F.regexp_replace(F.trim(F.coalesce(F.get(F.split(p, "\n", 2), F.lit(1)), F.lit(""))), r"^_No response_$", "").alias("v"))
    return F.map_from_entries(F.transform(parts, pair))


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """SNK-12, MSC-02: path, bytes and SHA-256 of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def review_blocks(text: F.Column, heading: str = "### ") -> F.Column:
    """SRC-05, GV-04: of every section of a Markdown document its key and the JSON of its one fenced block.

    problem is 'missing' without a block, 'duplicate' with several or if the key came before, else null.
    """
    parts = F.slice(F.split(F.concat(F.lit("\n"), text), "\n" + heading), 2, 1_000_000)
    key = lambda p: F.trim(F.split(p, "\n", 2)[0])
    blocks = lambda p: F.regexp_extract_all(p, F.lit("(?s)```json\\n(.*?)\\n```"), F.lit(1))
    keys = F.transform(parts, key)

    def block(p, i):
        b = blocks(p)
        again = F.array_position(keys, key(p)) < i + 1
        problem = F.when(F.size(b) == 0, "missing").when((F.size(b) > 1) | again, "duplicate")
        return F.struct(key(p).alias("key"), F.get(b, F.lit(0)).alias("json"), problem.alias("problem"))

    return F.transform(parts, block)


def accepted_local(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SRC-02: of scanned records (status, source, question, warnings, _corrupt) those that count, and one row of counters."""
    bad = F.col("_corrupt").isNotNull()
    fit = ~bad & (F.col("status") == "accepted") & (F.col("source") == "local")
    kept = fit & (F.size(F.coalesce("warnings", F.array().cast("array<string>"))) == 0) & (F.coalesce("question", F.lit("")) != "")
    counts = records.agg(F.count("*").alias("files"), F.count_if(bad).alias("corrupt"), F.count_if(fit).alias("eligible"), F.count_if(kept).alias("kept"))
    return records.where(F.coalesce(kept, F.lit(False))), counts
