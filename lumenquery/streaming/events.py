"""Structured Streaming over event files: watermarked windows, upserts, keyed state (ST-01/02/08/10, SNK-03)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, lateness: str | None = "2 days", files: int = 8) -> DataFrame:
    """A stream of the event files of a folder; event time in UTC, with a watermark (none if lateness is null)."""
    folder, _, name = path.rpartition("/")
    stream = spark.readStream.schema(SCHEMA).option("pathGlobFilter", name).option("maxFilesPerTrigger", files).parquet(folder)
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    return stream.withWatermark("ts", lateness) if lateness else stream


def tumbling(events: DataFrame, size: str = "1 day") -> DataFrame:
    return events.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str = "1 day", step: str = "6 hours") -> DataFrame:
    return events.groupBy(F.window("ts", size, step).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    return events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def first_of_key(events: DataFrame, *keys: str) -> DataFrame:
    """De-duplication whose state ends with the watermark: a key that comes again later than that comes through again, so its reader takes distinct keys."""
    return events.dropDuplicatesWithinWatermark(list(keys))


def run_once(df: DataFrame, out: str, checkpoint: str, mode: str = "update") -> None:
    """Everything that is there now, then stop; a restart goes on from the checkpoint.

    Each batch overwrites a folder of its own, so a batch that is replayed leaves the same rows.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id:08d}")

    df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()


def upserted(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """In update mode a key's row is the one of the last batch that changed it; the stream's state only holds what the watermark leaves open."""
    x = spark.read.parquet(out)
    others = [c for c in x.columns if c not in (*keys, "batch")]
    return x.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("r")).select(*keys, "r.*")
