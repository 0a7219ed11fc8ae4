"""Records and queues: choices, transitions, revisions, merges, suites of checks, small text helpers (FLT-*, ST-*, FB-*, JON-22, SNK-*, FN-*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def flat_text(nested: Column) -> Column:
    """FN-03: an array of arrays of texts, depth first, joined by spaces; blank values count for nothing."""
    return F.array_join(F.filter(F.flatten(F.transform(nested, lambda a: F.transform(a, lambda x: F.trim(F.coalesce(x, F.lit("")))))), lambda x: x != ""), " ")


def alternation(terms: list[str]) -> str:
    """FN-10: a pattern of terms, longer ones first, so that none hides another."""
    return "|".join(sorted(terms, key=lambda t: (-len(t), t)))


def ordinal(c: Column, levels: dict[str, int]) -> Column:
    """FN-33."""
    return F.create_map(*[x for k, v in levels.items() for x in (F.lit(k), F.lit(v))])[c]


def signature(content: Column, size: Column, least: int, magics: dict[str, bytes], small: str, other: str) -> Column:
    """FLT-09: the name of the first signature that the content begins with, if it is large enough."""
    out = F.when(size < least, small)
    for name, magic in magics.items():
        out = out.when(F.substring(content, 1, len(magic)) == F.lit(magic), name)
    return out.otherwise(other)


def least_coverage(known: Column, floor: int, share: float) -> Column:
    """FLT-12: how many rows a snapshot must hold of those known, rounded up."""
    return F.greatest(F.lit(floor).cast("long"), F.floor(known * share + 0.999))


def first_by(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """FLT-07: the first row of each key, and how many there were; aggregated before the shuffle."""
    others = [c for c in df.columns if c not in key]
    g = df.groupBy(*key).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("r"), F.count("*").alias("candidates"))
    return g.select(*key, "r.*", "candidates")


def suite(rules: dict[str, DataFrame]) -> DataFrame:
    """FLT-14: one row a rule, with the number of rows that break it."""
    out = None
    for name, df in rules.items():
        part = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("rule"), "n")
        out = part if out is None else out.union(part)
    return out


def revision_chain(df: DataFrame, key: list[str], order: list[str], value: str, event: str) -> DataFrame:
    """FB-03: (key, event, value, revision, superseded_by, status): rows that change the value, in order."""
    w = Window.partitionBy(*key).orderBy(*order)
    x = df.withColumn("before", F.lag(value).over(w)).where(F.col("before").isNull() | (F.col("before") != F.col(value)))
    x = x.select(*key, event, value, F.row_number().over(w).alias("revision"), F.lead(event).over(w).alias("superseded_by"))
    return x.withColumn("status", F.when(F.col("superseded_by").isNull(), "current").otherwise("superseded"))


def transition(state: DataFrame, moves: DataFrame, key: str, allowed: dict[str, list[str]]) -> DataFrame:
    """ST-03: (key, status, moved): rows take their resolution where their status allows it, others stay."""
    j = state.join(moves, key, "left")
    ok = F.lit(False)
    for status, targets in allowed.items():
        ok = ok | ((F.col("status") == status) & F.col("resolution").isin(targets))
    ok = F.coalesce(ok, F.lit(False))
    return j.select(key, F.when(ok, F.col("resolution")).otherwise(F.col("status")).alias("status"), ok.alias("moved"))


def queue(source: DataFrame, previous: DataFrame, finished: DataFrame, key: str, terminal: list[str]) -> DataFrame:
    """ST-04: (key, status, attempts, orphan): the source with its last state; rows that left the source stay if they are terminal."""
    s = source.select(key, F.lit(True).alias("here"))
    j = s.join(previous, key, "full").join(finished.select(key, F.lit(True).alias("has")), key, "left")
    j = j.where(F.col("here") | F.col("status").isin(terminal))
    status = F.when(F.col("has") & F.col("here"), "transcribed").otherwise(F.coalesce("status", F.lit("ready")))
    return j.select(key, status.alias("status"), F.coalesce("attempts", F.lit(0)).alias("attempts"), F.col("here").isNull().alias("orphan"))


def enrich(rows: DataFrame, ledger: DataFrame, key: str, column: str) -> DataFrame:
    """JON-22: the ledger's value where it has one, else the row's own."""
    j = rows.join(ledger.select(key, F.col(column).alias("new")), key, "left")
    return j.select(key, F.coalesce(F.nullif("new", F.lit("")), column).alias(column), (F.coalesce("new", F.lit("")) == "").alias("kept_old"))


def mismatches(source: DataFrame, copy: DataFrame, key: str, value: str) -> DataFrame:
    """SNK-11: rows that only one side has, or whose bytes differ; only digests move."""
    h = lambda df, n: df.select(key, F.md5(F.col(value).cast("binary")).alias(n))
    j = h(source, "a").join(h(copy, "b"), key, "full").where(~F.col("a").eqNullSafe(F.col("b")))
    return j.select(key, F.when(F.col("a").isNull(), "only_copy").when(F.col("b").isNull(), "only_source").otherwise("differs").alias("mismatch"))


def replace_one(text: Column, pattern: str, by: str) -> Column:
    """GV-06: the text with the pattern replaced if it is there exactly once, else null."""
    return F.when(F.regexp_count(text, F.lit(pattern)) == 1, F.regexp_replace(text, pattern, by))


def diagram_label(c: Column) -> Column:
    """FN-25: quotes and ampersands escaped."""
    return F.replace(F.replace(c, F.lit('"'), F.lit("#quot;")), F.lit("&"), F.lit("#amp;"))


def diagram_edge(a: Column, b: Column) -> Column:
    """SNK-07: a line of a flow diagram."""
    return F.concat(F.lit('  "'), diagram_label(a), F.lit('" --> "'), diagram_label(b), F.lit('"'))
