"""Ordered analytics: context windows, buckets, revisions, fills, samples, apportionment, greedy choices (WIN-*, SRT-07/09/11/12, JON-12)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenquery.sources.stored import shared_folder


def context(df: DataFrame, key: str, order: str, text: str, reach: int) -> DataFrame:
    """WIN-01/02: the rows up to `reach` before and after, as one text with its first and last position."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-reach, reach)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))).over(w)), lambda x: x["t"]), " ")
    return df.withColumn("window", joined).withColumn("w_start", F.min(order).over(w)).withColumn("w_end", F.max(order).over(w))


def bucket_best(df: DataFrame, key: str, at: str, score: str, tie: str, buckets: int) -> DataFrame:
    """WIN-03: equal-width buckets between a key's first and last position; the best row of each bucket."""
    w = Window.partitionBy(key)
    span = F.max(at).over(w) - F.min(at).over(w)
    x = df.withColumn("bucket", F.least(F.lit(buckets - 1), F.floor((F.col(at) - F.min(at).over(w)) * buckets / F.greatest(span, F.lit(1)))))
    return x.withColumn("k", F.row_number().over(Window.partitionBy(key, "bucket").orderBy(F.desc(score), tie))).where("k = 1").drop("k")


def first_seen(df: DataFrame, key: str, order: str) -> DataFrame:
    """WIN-07: the first row of each key; aggregated before the shuffle."""
    others = [c for c in df.columns if c not in (key,)]
    return df.groupBy(key).agg(F.min_by(F.struct(*others), order).alias("r")).select(key, "r.*")


def revisions(df: DataFrame, key: str, order: list[str], value: Column) -> DataFrame:
    """WIN-12/13: rows that change the value, numbered; all but the last are superseded."""
    w = Window.partitionBy(key).orderBy(*order)
    x = df.withColumn("v", value).withColumn("before", F.lag("v").over(w)).where(F.col("before").isNull() | (F.col("before") != F.col("v")))
    return x.withColumn("revision", F.row_number().over(w)).withColumn("superseded", F.lead("v").over(w).isNotNull()).drop("before")


def numbered(df: DataFrame, order: list, name: str = "pos") -> DataFrame:
    """Rows with their place (from 0) in a global order, without one task for all: ranges, places within them, and offsets.

    The ranges are written first, as sampling could cut them otherwise when a task runs again; ties beyond `order` may
    take their places either way.
    """
    shared_folder(df.sparkSession)
    x = df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()).checkpoint()
    sizes = x.groupBy("__part").agg(F.count("*").alias("__n"))  # a row a partition
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    x = x.join(F.broadcast(sizes.select("__part", before.alias("__before"))), "__part")
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return x.withColumn(name, F.col("__before") + place - 1).drop("__part", "__before")


def even_sample(df: DataFrame, order: str, n: int) -> DataFrame:
    """SRT-09: rows at the positions round(i * (N - 1) / (n - 1)), half to even."""
    total = df.count()
    spots = df.sparkSession.range(min(n, total)).select(F.bround(F.col("id") * (total - 1) / max(1, n - 1)).cast("long").alias("pos")).distinct()
    return numbered(df, [order]).join(F.broadcast(spots), "pos")


def apportion(df: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """SRT-12: one each, then floors of the rest, then one more to the largest remainders; they add up to total.

    df has a row a share (total at most), so its one window is bounded.
    """
    s = df.agg(F.sum(weight).alias("__sum"), F.count("*").alias("__rows"))
    x = df.join(F.broadcast(s)).withColumn("__exact", F.col(weight) * (F.lit(total) - F.col("__rows")) / F.col("__sum")).withColumn("__base", F.floor("__exact") + 1)
    left = F.lit(total) - F.sum("__base").over(Window.partitionBy())
    rank = F.row_number().over(Window.orderBy(F.desc(F.round(F.col("__exact") - F.floor("__exact"), 9)), key))
    return x.select(key, (F.col("__base") + F.when(rank <= left, 1).otherwise(0)).alias("share"))


def greedy_windows(df: DataFrame, key: str, limit: int) -> DataFrame:
    """JON-12, K11: of (key, w_start, w_end, score), the best that overlap none chosen before; a key's rows are few after pruning."""

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows, taken = rows.sort_values(["score", "w_start", "w_end"], ascending=[False, True, True]), []
        for r in rows.itertuples():
            if len(taken) < limit and all(r.w_end < t.w_start or r.w_start > t.w_end for t in taken):
                taken.append(r)
        return rows.loc[[t.Index for t in taken]]

    return df.groupBy(key).applyInPandas(pick, df.schema)


def diversify(df: DataFrame, key: str, limit: int) -> DataFrame:
    """SRT-07: of (key, item, concepts, score), repeatedly the item with the most new concepts, then score, then the least item.

    A pick is one aggregation over all partitions, of which each gives its best candidate of a key, so no task holds a key's rows;
    what moves between picks is a row a key.
    """
    shared_folder(df.sparkSession)
    x = df.select(F.col(key).alias("k"), "item", F.array_distinct(F.coalesce("concepts", F.array().cast(df.schema["concepts"].dataType))).alias("concepts"), "score").checkpoint()
    best = F.min_by(F.struct("item", "concepts"), F.struct((-F.col("gain")).alias("g"), (-F.col("score")).alias("s"), "item"))
    picks = None
    for i in range(1, limit + 1):
        left = x.withColumn("gain", F.size("concepts"))
        if picks is not None:
            seen = picks.groupBy("k").agg(F.array_distinct(F.flatten(F.collect_list("concepts"))).alias("seen"), F.collect_list("item").alias("taken"))
            left = left.join(seen.withColumnRenamed("k", "k2"), F.col("k").eqNullSafe(F.col("k2"))).where(~F.array_contains("taken", F.col("item")))
            left = left.withColumn("gain", F.size(F.array_except("concepts", "seen")))
        found = left.groupBy("k").agg(best.alias("b")).select("k", F.lit(i).alias("pick"), "b.item", "b.concepts")
        picks = (found if picks is None else picks.union(found)).checkpoint()
    return picks.select(F.col("k").alias(key), "pick", "item")
