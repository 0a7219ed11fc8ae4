"""JON-21, ST-06: what was announced against what arrived, as an outer join of two streams with a watermark on each side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def meet(announced: DataFrame, arrived: DataFrame, within: str) -> DataFrame:
    """(key, announced_id, announced_at, arrived_id, arrived_at): every arrival of the key within `within` of the announcement, or
    nulls once the watermarks tell that none can come any more.  Both sides, streams or tables, have (key, id, at); a stream's state holds
    what is younger than `within` and its lateness."""
    a = announced.select("key", F.col("id").alias("announced_id"), F.col("at").alias("announced_at"))
    b = arrived.select(F.col("key").alias("arrived_key"), F.col("id").alias("arrived_id"), F.col("at").alias("arrived_at"))
    near = (F.col("key") == F.col("arrived_key")) & (F.col("arrived_at") >= F.col("announced_at")) & F.expr(f"arrived_at <= announced_at + interval {within}")
    return a.join(b, near, "left_outer").drop("arrived_key")


def outcomes(met: DataFrame, until: Column, within: str, on_time: str) -> DataFrame:
    """(key, announced_id, outcome, arrived_id): of each announcement that was over at `until` its first arrival: matched, late or missing.

    Arrivals come as rows of their own, of which the earliest counts, so what a stream repeats after a restart changes nothing.
    """
    over = met.where(F.expr(f"announced_at + interval {within}") < until)
    first = over.groupBy("key", "announced_id", "announced_at").agg(F.min(F.when(F.col("arrived_id").isNotNull(), F.struct("arrived_at", "arrived_id"))).alias("x"))
    outcome = F.when(F.col("x").isNull(), "missing").when(F.col("x.arrived_at") <= F.expr(f"announced_at + interval {on_time}"), "matched").otherwise("late")
    return first.select("key", "announced_id", outcome.alias("outcome"), F.col("x.arrived_id").alias("arrived_id"))
