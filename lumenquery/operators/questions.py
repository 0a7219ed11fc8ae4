"""Understanding of questions by rule tables: modes, scopes, axis values, implications, actors, hypotheses (FN-*, QU-*, JON-11/16).

Texts come with their key columns; rule tables are small and fixed, so they are broadcast and met by containment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def meets(texts: DataFrame, rules: DataFrame, text: str = "text", term: str = "term") -> DataFrame:
    """Rows of texts with each rule whose term they hold."""
    return texts.join(F.broadcast(rules), F.contains(text, term))


def answer_mode(texts: DataFrame, rules: DataFrame, key: list[str], margin: float, default: str) -> DataFrame:
    """FN-14: (key, mode, score): weights add up by mode; a decisive term settles it, else the best mode needs a margin over the next."""
    per = meets(texts, rules).groupBy(*key, "mode").agg(F.sum("weight").alias("score"), F.max(F.col("decisive").cast("int")).alias("decisive"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("decisive")).alias("d"), (-F.col("score")).alias("s"), F.col("mode").alias("mode"))))
    best = per.groupBy(*key).agg(order.alias("o"))
    first, second = F.get("o", F.lit(0)), F.get("o", F.lit(1))
    sure = (first["d"] < 0) | (-first["s"] + F.coalesce(second["s"], F.lit(0.0)) >= margin)
    best = best.select(*key, F.when(sure, first["mode"]).otherwise(default).alias("mode"), F.round(-first["s"], 4).alias("score"))
    return texts.select(*key).join(best, key, "left").select(*key, F.coalesce("mode", F.lit(default)).alias("mode"), F.coalesce("score", F.lit(0.0)).alias("score"))


def any_of(text: Column, terms: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(text, t))


def requested_output(text: Column, rules: dict[str, tuple[list[str], list[str]]], default: str) -> Column:
    """FN-15: the first output with one of its terms and none of those that suppress it."""
    out = F
    for name, (terms, without) in rules.items():
        ok = any_of(text, terms) & ~any_of(text, without) if without else any_of(text, terms)
        out = out.when(ok, name)
    return out.otherwise(default)


def negative_scopes(text: Column, markers: list[str], contrasts: list[str]) -> Column:
    """FN-16: what a marker word excludes: up to a contrast word or punctuation; an array in order of the text."""
    found = F.regexp_extract_all(text, F.lit(rf"(?:^|[\s,.;])(?:{'|'.join(markers)})\s+([^,.;\n]+)"), F.lit(1))
    cut = F.transform(found, lambda s: F.trim(F.regexp_replace(F.concat(s, F.lit(" ")), rf"\s(?:{'|'.join(contrasts)})\s.*$", "")))
    return F.filter(cut, lambda s: s != "")


def without_scopes(text: Column, markers: list[str]) -> Column:
    """FN-16: the text without its markers and what they exclude."""
    return F.trim(F.regexp_replace(text, rf"(^|[\s,.;])(?:{'|'.join(markers)})\s+[^,.;\n]+", "$1"))


def shards(text: Column, stop: list[str], ideographs: str) -> Column:
    """FN-05: words of two or more ASCII letters or digits; runs of 2 to 6 ideographs, and the 2- to 4-grams of all runs; no stop phrases."""
    words = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]{2,})"), F.lit(1))
    runs = F.filter(F.regexp_extract_all(F.lower(text), F.lit(f"([{ideographs}]+)"), F.lit(1)), lambda r: F.length(r) >= 2)
    grams = lambda k: F.flatten(F.transform(F.filter(runs, lambda r: F.length(r) >= k), lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - k + 1), lambda i: F.substring(r, i, F.lit(k)))))
    out = F.concat(words, F.filter(runs, lambda r: F.length(r) <= 6), grams(2), grams(3), grams(4))
    return F.array_except(F.array_distinct(out), F.array(*map(F.lit, stop)))


def positions(text: Column, term: str) -> Column:
    """All places (from 0) of a term, overlapping ones too."""
    pieces = F.split(text, f"(?={term})")  # cut before each occurrence, so all pieces but perhaps the first begin with one
    step = lambda acc, p: F.struct((acc["at"] + F.length(p)).alias("at"), F.when((acc["at"] > 0) | F.startswith(text, F.lit(term)), F.concat(acc["hits"], F.array(acc["at"]))).otherwise(acc["hits"]).alias("hits"))
    return F.aggregate(pieces, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("hits")), step, lambda acc: acc["hits"])


def occurrences(texts: DataFrame, key: list[str], text: str, terms: list[str]) -> DataFrame:
    """JON-10: (key, term, start, end) of every occurrence of fixed terms (letters only)."""
    each = F.array(*[F.struct(F.lit(t).alias("term"), positions(F.col(text), t).alias("at")) for t in terms])
    x = texts.select(*key, F.explode(each).alias("o")).select(*key, "o.term", F.explode("o.at").alias("start"))
    return x.withColumn("end", F.col("start") + F.length("term"))


def axis_values(texts: DataFrame, key: list[str], text: str, rules: list[tuple[str, str, str]], spark) -> DataFrame:
    """JON-11, QU-12: (key, axis, value) by rules (axis, value, term); a match inside a longer one of another value of the axis is shadowed."""
    hits = occurrences(texts, key, text, sorted({r[2] for r in rules}))
    hits = hits.join(F.broadcast(spark.createDataFrame(rules, "axis string, value string, term string")), "term")
    # a longer match can only cover one that starts in its range: equal starts are met through the covered places
    cover = hits.select(*key, "axis", F.col("value").alias("v2"), F.col("start").alias("s2"), F.col("end").alias("e2"), F.explode(F.sequence("start", F.col("end") - 1)).alias("at"))
    shadow = hits.withColumn("at", F.col("start")).join(cover, [*key, "axis", "at"]).where("v2 <> value and e2 >= end and e2 - s2 > end - start")
    return hits.join(shadow.select(*key, "axis", "value", "start", "end").distinct(), [*key, "axis", "value", "start", "end"], "left_anti").select(*key, "axis", "value").distinct()


def implied(values: DataFrame, implications: list[tuple[str, str, str, str]], key: list[str]) -> DataFrame:
    """QU-13: rules (axis, value, then_axis, then_value) in their order add a value where the axis has none yet; (key, axis, value, source).

    One row a key holds its axes as arrays, so a rule sees what those before it added without another shuffle.
    """
    per = values.groupBy(*key).agg(F.array_sort(F.collect_set(F.struct("axis", "value", F.lit("text").alias("source")))).alias("v"))
    for axis, value, then_axis, then_value in implications:
        on = F.exists("v", lambda x: (x["axis"] == axis) & (x["value"] == value)) & ~F.exists("v", lambda x: x["axis"] == then_axis)
        add = F.array(F.struct(F.lit(then_axis).alias("axis"), F.lit(then_value).alias("value"), F.lit("implied").alias("source")))
        per = per.withColumn("v", F.when(on, F.concat("v", add)).otherwise(F.col("v")))
    return per.select(*key, F.explode("v").alias("x")).select(*key, "x.*")


def ordered_gap(hits: DataFrame, rules: DataFrame, key: list[str]) -> DataFrame:
    """JON-16: rules (rule, before, after, max_gap, implies): a term, then another at most max_gap behind its end; each key's first rule.

    hits: (key, term, start, end).  The range join is by buckets of the largest gap, so no text's occurrences are paired with all others.
    """
    width = 32
    b = hits.join(F.broadcast(rules), F.col("term") == F.col("before")).select(*key, "rule", "after", "max_gap", "implies", F.col("end").alias("b_end"))
    b = b.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("b_end") / width), F.floor((F.col("b_end") + F.col("max_gap")) / width))))
    a = hits.select(*key, F.col("term").alias("after"), F.col("start").alias("a_start"), F.floor(F.col("start") / width).alias("bucket"))
    j = b.join(a, [*key, "after", "bucket"]).where("a_start between b_end and b_end + max_gap")
    return j.groupBy(*key).agg(F.min(F.struct("rule", "implies")).alias("m"), F.count("*").alias("n")).select(*key, "m.rule", "m.implies", "n")


def unless(triggers: DataFrame, resolved: DataFrame, on: list[str]) -> DataFrame:
    """QU-17: rules that a text triggers and nothing in it resolves."""
    return triggers.join(resolved.select(*on).distinct(), on, "left_anti")


def hypotheses(text: Column, pattern: str, mark: str, suffix: str) -> Column:
    """QU-18: groups of a pattern, split on the list mark, without suffixes; distinct in order."""
    parts = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda s: F.split(s, mark)))
    return F.array_distinct(F.filter(F.transform(parts, lambda s: F.trim(F.regexp_replace(F.trim(s), suffix, ""))), lambda s: s != ""))


def not_negated(hits: DataFrame, negators: list[str], reach: int, text: str = "text") -> DataFrame:
    """QU-19: occurrences without a negator in the `reach` characters before them."""
    before = F.expr(f"substring({text}, greatest(1, start - {reach - 1}), least(start, {reach}))")
    return hits.where(~any_of(before, negators))


def actor_segments(texts: DataFrame, key: list[str], actors: list[str], pronouns: list[str], separators: str) -> DataFrame:
    """QU-14, WIN-14: runs of words under one actor: (key, segment, actor, n_words, words).

    A word that names an actor holds until the next one or the end of the sentence; a pronoun brings the last one named back.
    """
    w = F.posexplode(F.split(F.trim(F.regexp_replace(F.lower("text"), separators, " | ")), r"\s+")).alias("pos", "word")
    x = texts.select(*key, w).where("word <> ''")
    order = Window.partitionBy(*key).orderBy("pos")
    named = F.when(F.col("word").isin(actors), F.col("word"))
    x = x.withColumn("sentence", F.sum((F.col("word") == "|").cast("int")).over(order)).withColumn("last", F.last(named, ignorenulls=True).over(order))
    x = x.withColumn("mark", F.when(F.col("word").isin(actors), F.col("word")).when(F.col("word").isin(pronouns), F.coalesce("last", F.lit("someone"))))
    x = x.withColumn("actor", F.coalesce(F.last("mark", ignorenulls=True).over(Window.partitionBy(*key, "sentence").orderBy("pos")), F.lit("nobody"))).where("word <> '|'")
    x = x.withColumn("new", (F.coalesce(F.lag(F.concat("sentence", F.lit(":"), "actor")).over(order), F.lit("")) != F.concat("sentence", F.lit(":"), "actor")).cast("int"))
    x = x.withColumn("segment", F.sum("new").over(order))
    words = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda s: s["word"]), " ")
    return x.groupBy(*key, "segment", "actor").agg(F.count("*").alias("n_words"), words.alias("words"))


def continuation(turns: DataFrame, key: str, order: str, resolves: Column, max_turns: int) -> DataFrame:
    """QU-09/10: a fold over a dialogue's answers: (key, state, turns, digest).

    State goes open -> resolved at the first answer that resolves it, or -> expired beyond max_turns; the digest chains
    SHA-256 over the answers taken, so a stale state is told by its digest.
    """
    rows = turns.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("text").alias("text"), resolves.alias("done")))).alias("r"))
    zero = F.struct(F.lit("open").alias("state"), F.lit(0).alias("turns"), F.lit("").alias("digest"))

    def step(acc, r):
        live = acc["state"] == "open"
        full = acc["turns"] >= max_turns
        state = F.when(~live, acc["state"]).when(full, "expired").when(r["done"], "resolved").otherwise("open")
        take = live & ~full
        return F.struct(state.alias("state"), (acc["turns"] + F.when(take, 1).otherwise(0)).alias("turns"), F.when(take, F.sha2(F.concat(acc["digest"], r["text"]).cast("binary"), 256)).otherwise(acc["digest"]).alias("digest"))

    return rows.select(key, F.aggregate("r", zero, step).alias("s")).select(key, "s.*")


def units_with_constraints(units: DataFrame, terms: DataFrame, key: list[str]) -> DataFrame:
    """QU-08: every unit, led by those constraint terms of its question that it doesn't hold: (key, unit, planned)."""
    t = terms.groupBy(*key).agg(F.array_sort(F.collect_set("term")).alias("terms"))
    j = units.join(t, key, "left")
    missing = F.filter(F.coalesce("terms", F.array().cast("array<string>")), lambda x: ~F.contains("unit", x))
    return j.select(*key, "unit", F.trim(F.concat_ws(" ", missing, "unit")).alias("planned")).distinct()


def session_minutes(text: Column) -> dict[str, Column]:
    """FN-20: minutes in digits, in numerals up to 99, or half an hour; and which."""
    digits = F.regexp_extract(text, "([0-9]+)分钟", 1)
    cjk = F.regexp_extract(text, "([一二三四五六七八九]?十?[一二三四五六七八九]?)分钟", 1)
    value = lambda c: F.instr(F.lit("一二三四五六七八九"), c)
    head, tail = F.substring_index(cjk, "十", 1), F.substring_index(cjk, "十", -1)
    numeral = F.when(F.contains(cjk, F.lit("十")), F.when(head == "", 1).otherwise(value(head)) * 10 + F.when(tail == "", 0).otherwise(value(tail))).otherwise(value(cjk))
    half = F.contains(text, F.lit("半小时"))
    return {"minutes": F.when(half, 30).when(digits != "", F.try_to_number(digits, F.lit("999")).cast("int")).otherwise(numeral).cast("int"), "source": F.when(half, "half_hour").when(digits != "", "digits").otherwise("numeral")}
