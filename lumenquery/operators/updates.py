"""ST-01: what a snapshot brings that is new, classified and fanned out into several tables of one transaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenquery.sources.journal import Journal


def arrivals(snapshot: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """JON-04: rows of the snapshot with keys that aren't known; of rows of one key the least."""
    new = snapshot.join(known.select(key).distinct(), key, "left_anti")
    others = [c for c in snapshot.columns if c != key]
    return new.groupBy(key).agg(F.min(F.struct(*others)).alias("r")).select(key, "r.*")


def fan_out(new: DataFrame, key: str, decision: Column, reason: Column, batch: str) -> dict[str, DataFrame]:
    """The rows that a batch adds to each table, by its decision ('teaching', 'review' or 'excluded'):

    index: all rows; ledger: each row's decision and reason; queue: what waits for work, reviews before the rest;
    discovery: one row of running counts.
    """
    x = new.withColumn("decision", decision).withColumn("reason", reason)
    queue = x.where("decision <> 'excluded'").select(key, F.when(F.col("decision") == "review", "needs_review").otherwise("pending").alias("status"), F.lit(0).alias("attempts"))
    counts = [F.count_if(F.col("decision") == d).alias(d) for d in ("teaching", "review", "excluded")]
    return {
        "index": x.select(key, F.lit(batch).alias("batch"), *[c for c in new.columns if c != key]),
        "ledger": x.select(key, "decision", "reason", F.lit(batch).alias("batch")),
        "queue": queue.withColumn("batch", F.lit(batch)),
        "discovery": x.agg(F.count("*").alias("arrived"), *counts).withColumn("batch", F.lit(batch)),
    }


def apply_update(journal: Journal, snapshot: DataFrame, key: str, decision: Column, reason: Column, batch: str) -> int:
    """Diff against the journal's index and commit all tables together; a batch that is in the journal already changes nothing."""
    base = journal.version()
    if any(e["note"].get("batch") == batch for _, e in journal.entries()):
        return base
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in snapshot.schema)
    new = arrivals(snapshot, journal.read("index", base, f"{schema}, batch string"), key)
    return journal.commit(fan_out(new, key, decision, reason, batch), base, note={"batch": batch})
