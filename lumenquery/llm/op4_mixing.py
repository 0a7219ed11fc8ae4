"""Mixing sources to target weights: iterative proportional fitting, then calibrated sampling.

Only DataFrame functions.  Documents are reduced to one row per (source, lang,
topic) cell before anything is shuffled, so a source with a third of all rows
costs no more than another; the cells' token weights are raked in turn to the
source, language and topic marginals until the largest relative error is below
`tolerance`, or `rounds` are done.  The factor weight/tokens of a cell then
becomes the inclusion probability min(1, c * factor), c such that the expected
number of sampled tokens is `keep` of all tokens.

Defined results: null text has no tokens; null source, language or topic is a
value of its own ("(null)"); documents without tokens have probability 0 and are never
sampled; a cell that the targets give nothing has probability 0; an empty table gives no rows.
Repeated rows with equal doc_id are sampled or left together.  Columns of the
input other than those made here pass through untouched by name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, fresh, materialize

#: Production parameters.
KEEP, ALPHA, ROUNDS, TOLERANCE, SEED = 0.5, 0.7, 60, 1e-6, "mix-1"
AXES = ("source", "lang", "topic")


def tokens_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def topic_of(text: Column) -> Column:
    """A topic by rule: what the text's marks say that it is about."""
    t = F.coalesce(text, F.lit(""))
    return (
        F.when(t.contains(" | "), "tables")
        .when(t.contains("$$$") | t.contains("&&&") | t.contains("###"), "markup")
        .when(t.contains("@"), "contact")
        .when(F.length(t) < 600, "notes")
        .otherwise("prose")
    )


def uniform(doc_id: Column, seed: str) -> Column:
    """A number in [0, 1) for a document, by MD5: the same in any engine."""
    digits = F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary")), 1, 12)
    return F.conv(digits, 16, 10).cast("double") / float(16**12)


def targets_by_temperature(cells: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """Target shares (axis, value, share): each axis's token shares to the power alpha, made to add up to 1."""
    long = cells.select(F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("value"), F.col("tokens")) for a in AXES])).alias("s")).select("s.*")
    by = long.groupBy("axis", "value").agg(F.sum("tokens").alias("tokens")).where("tokens > 0")
    power = F.pow(F.col("tokens").cast("double"), F.lit(alpha))
    total = by.groupBy("axis").agg(F.sum(power).alias("total"))
    return by.join(F.broadcast(total), "axis").select("axis", "value", (power / F.col("total")).alias("share"))


def rake(cells: DataFrame, targets: DataFrame, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """Cells (source, lang, topic, tokens) with weight: shares that add up to 1 and meet the targets' marginals."""
    w = cells.where("tokens > 0")
    for a in AXES:
        t = targets.where(F.col("axis") == a).select(F.col("value").alias(a), F.col("share").alias(f"t_{a}"))
        w = w.join(t, a, "left").withColumn(f"t_{a}", F.coalesce(f"t_{a}", F.lit(0.0)))
    w = materialize(w.withColumn("weight", F.col("tokens").cast("double")), "cells")
    done = 0
    while done < rounds:
        for _ in range(3):
            for a in AXES:
                total = F.sum("weight").over(Window.partitionBy(a))
                w = w.withColumn("weight", F.when(total > 0, F.col("weight") * F.col(f"t_{a}") / total).otherwise(0.0))
            done += 1
        w = w.checkpoint()
        # after a round only the last axis is met exactly; the others tell how far it has come
        worst = max(
            (w.groupBy(a, f"t_{a}").agg(F.sum("weight").alias("s")).where(f"t_{a} > 0").agg(F.max(F.abs(F.col("s") / F.col(f"t_{a}") - 1))).first()[0] or 0.0)
            for a in AXES[:-1]
        )
        if worst <= tolerance:
            break
    return w.select(*AXES, "tokens", "weight")


def calibrate(raked: DataFrame, keep: float = KEEP) -> DataFrame:
    """Cells with p, the inclusion probability, for which the expected tokens are `keep` of all (or all that can be had)."""
    r = raked.withColumn("factor", F.col("weight") / F.col("tokens"))
    row = r.agg(F.sum("tokens"), F.sum(F.when(F.col("factor") > 0, F.col("tokens")).otherwise(0))).first()
    total, reachable = (row[0] or 0), (row[1] or 0)
    budget, c = min(keep * total, reachable), 0.0
    while True:  # each round holds more cells at 1, so this ends
        full = F.col("factor") * c >= 1
        held, free = r.agg(F.sum(F.when(full, F.col("tokens")).otherwise(0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        new = (budget - (held or 0)) / free if free else c
        if not free or new <= c * (1 + 1e-12):
            break
        c = new
    return r.withColumn("p", F.least(F.lit(1.0), F.col("factor") * c))


def mix(docs: DataFrame, targets: DataFrame | None = None, keep: float = KEEP, seed: str = SEED) -> DataFrame:
    """Every document with mix_tokens, mix_topic, mix_weight (its share of all target tokens), mix_p and mix_sampled.

    Names of these that docs has already get underscores before them.
    """
    null = F.lit("(null)")
    axes = [fresh(docs, f"cell_{a}") for a in AXES]
    tokens, factor, p = (fresh(docs, c) for c in ("cell_tokens", "cell_factor", "cell_p"))
    d = docs.select("*", F.coalesce(F.col("source"), null).alias(axes[0]), F.coalesce(F.col("lang"), null).alias(axes[1]), topic_of(F.col("text")).alias(axes[2]), tokens_of(F.col("text")).alias(tokens))
    cells = materialize(d.groupBy(*[F.col(c).alias(a) for c, a in zip(axes, AXES, strict=True)]).agg(F.sum(tokens).alias("tokens")), "mixcells")
    of = calibrate(rake(cells, targets_by_temperature(cells) if targets is None else targets), keep)
    of = materialize(of.select(*[F.col(a).alias(c) for c, a in zip(axes, AXES, strict=True)], F.col("factor").alias(factor), F.col("p").alias(p)), "mixp")
    out = d.join(of, axes, "left")
    prob = F.when(F.col(tokens) > 0, F.coalesce(p, F.lit(0.0))).otherwise(0.0)
    new = {
        "mix_tokens": F.col(tokens), "mix_topic": F.col(axes[2]), "mix_weight": F.coalesce(factor, F.lit(0.0)) * F.col(tokens),
        "mix_p": prob, "mix_sampled": uniform(F.col("doc_id"), seed) < prob,
    }
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], *[c.alias(fresh(docs, n)) for n, c in new.items()])


def sample(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of docs that mix() samples, as they are."""
    return mix(docs, **parameters).where(F.col(fresh(docs, "mix_sampled"))).select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs.select("doc_id", "source", "lang", "text")).select("doc_id", "source", "lang", "mix_topic", "mix_tokens", "mix_weight", "mix_p", "mix_sampled")
