"""SRC-06, MSC-17: review notes in Markdown as a source that is upserted, and reviewed atoms with their groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenquery.sources.journal import Journal

NOTES = "key string, fields map<string,string>, digest string, batch long"


def section(key: Column, fields: dict[str, Column]) -> Column:
    """One note as Markdown: a heading with its key, a line for each field that isn't null."""
    lines = [F.when(c.isNotNull(), F.concat(F.lit(f"- {name}: "), F.regexp_replace(c.cast("string"), r"\s+", " "))) for name, c in fields.items()]
    return F.concat_ws("\n", F.concat(F.lit("### "), key), *lines)


def scan(spark: SparkSession, path: str) -> DataFrame:
    """(key, fields, digest) of all notes of the Markdown files below a folder; of a key that several files or sections have, the last by file name and place.

    A note is a heading of three #, then lines `- name: value`; other lines are left out, as are notes without a key.
    """
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("file"), "value")
    parts = F.slice(F.split(F.concat(F.lit("\n"), "value"), "\n### "), 2, 1 << 30)
    s = files.select("file", F.posexplode(parts).alias("place", "s")).select("file", "place", F.trim(F.split("s", "\n", 2)[0]).alias("key"), F.coalesce(F.get(F.split("s", "\n", 2), F.lit(1)), F.lit("")).alias("body")).where("key <> ''")
    pairs = F.filter(F.transform(F.split("body", "\n"), lambda x: F.regexp_extract_all(x, F.lit(r"^- ([^:]+): (.*)$"), F.lit(0))), lambda m: F.size(m) > 0)
    entry = F.transform(pairs, lambda m: F.struct(F.trim(F.regexp_extract(m[0], r"^- ([^:]+): (.*)$", 1)).alias("k"), F.trim(F.regexp_extract(m[0], r"^- ([^:]+): (.*)$", 2)).alias("v")))
    names = F.array_distinct(F.transform(entry, lambda e: e["k"]))
    fields = F.map_from_arrays(names, F.transform(names, lambda n: F.element_at(F.filter(entry, lambda e: e["k"] == n), -1)["v"]))  # a name's last line counts
    last = s.groupBy("key").agg(F.max_by("body", F.struct("file", "place")).alias("body")).withColumn("entry", entry)
    return last.select("key", fields.alias("fields"), F.sha2(F.col("body").cast("binary"), 256).alias("digest")).select("key", "fields", "digest")


def upsert(journal: Journal, notes: DataFrame) -> dict[str, int]:
    """Notes that are new or differ become a batch of the journal's table `notes`; how many were added, changed and left as they are."""
    base = journal.version()
    have = current(journal, base).select("key", F.col("digest").alias("old"))
    kind = F.when(F.col("old").isNull(), "added").when(F.col("old") != F.col("digest"), "changed").otherwise("unchanged")
    x = notes.join(have, "key", "left").withColumn("kind", kind).cache()
    try:
        counts = {r.kind: r.n for r in x.groupBy("kind").agg(F.count("*").alias("n")).collect()}
        if counts.get("added", 0) + counts.get("changed", 0):
            journal.commit({"notes": x.where("kind <> 'unchanged'").select("key", "fields", "digest", F.lit(base + 1).cast("long").alias("batch"))}, base)
    finally:
        x.unpersist()
    return {k: counts.get(k, 0) for k in ("added", "changed", "unchanged")}


def current(journal: Journal, version: int | None = None) -> DataFrame:
    """(key, fields, digest, batch): of each note the last batch's."""
    x = journal.read("notes", version, NOTES)
    return x.groupBy("key").agg(F.max_by(F.struct("fields", "digest", "batch"), "batch").alias("r")).select("key", "r.*")


def grouped_atoms(atoms: DataFrame, groups: DataFrame) -> DataFrame:
    """MSC-17: atoms (atom_id, ...) with the least member of their equivalence group; groups: (members array of ids).

    An id that comes twice, a group of unknown members and an atom of two groups are errors, told when the rows are read.
    """
    fail = lambda bad, what, id_: F.when(bad, F.raise_error(F.concat(F.lit(what), F.col(id_).cast("string"))).cast("boolean")).otherwise(F.lit(True))
    n = atoms.groupBy("atom_id").agg(F.count("*").alias("n"))
    g = groups.select(F.array_min("members").alias("group_id"), F.explode(F.array_distinct("members")).alias("atom_id"))
    g = g.groupBy("atom_id").agg(F.min("group_id").alias("group_id"), F.count("*").alias("of_groups"))
    x = n.join(g, "atom_id", "full").where(fail(F.col("n").isNull(), "unknown atom: ", "atom_id") & fail(F.col("n") > 1, "repeated atom: ", "atom_id") & fail(F.col("of_groups") > 1, "atom of several groups: ", "atom_id"))
    return atoms.join(x.select("atom_id", F.coalesce("group_id", "atom_id").alias("group_id")), "atom_id")
