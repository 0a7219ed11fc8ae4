"""One pass over texts for all terms of a lexicon: occurrences, counts, longest matches, replacements (JON-06/07, JON-10/11, FN-06/09/10).

The lexicon's terms become an Aho-Corasick automaton, so a text takes time by its length and its matches, however many
terms there are.  What is broadcast is bounded: a lexicon of more than CHARACTERS is dealt into several automata, each with a
pass of its own; the matches that shadow each other meet afterwards, by text and place.
Terms are unique and not empty; places are code points from 0, ends exclusive.  Null texts have no matches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHARACTERS = 4_000_000
_BUILT: dict[int, object] = {}


def _automaton(shared):
    """The automaton of a broadcast list of terms, made once a worker."""
    import ahocorasick

    if shared.value[0] not in _BUILT:
        _BUILT.clear()
        a = ahocorasick.Automaton()
        for term in shared.value[1]:
            a.add_word(term, term)
        a.make_automaton()
        _BUILT[shared.value[0]] = a
    return _BUILT[shared.value[0]]


def lexicons(terms: DataFrame, most: int = CHARACTERS) -> list[list[str]]:
    """The distinct terms of a rule table (one string column), in lists of bounded length."""
    out, size = [[]], 0
    for (term,) in terms.where(F.length(F.col(terms.columns[0])) > 0).distinct().toLocalIterator():
        if size + len(term) > most and out[-1]:
            out.append([])
            size = 0
        out[-1].append(term)
        size += len(term)
    return [sorted(x) for x in out if x]


def every(a, text: str) -> list[tuple[int, int, str]]:
    """All occurrences, by end."""
    return [(end + 1 - len(term), end + 1, term) for end, term in a.iter(text)]


def counted(a, text: str) -> list[tuple[int, int, str]]:
    """Of each term the occurrences that a scan from the left finds without overlap."""
    last: dict[str, int] = {}
    out = []
    for start, end, term in every(a, text):
        if start >= last.get(term, 0):
            last[term] = end
            out.append((start, end, term))
    return out


def maximal(found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Without those that lie inside a longer one."""
    out, reach = [], 0
    for start, end, term in sorted(found, key=lambda m: (m[0], -m[1])):
        if end > reach:
            out.append((start, end, term))
            reach = end
    return out


def leftmost(found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """From the left, the longest at each place, none overlapping."""
    out, reach = [], 0
    for start, end, term in sorted(found, key=lambda m: (m[0], -m[1])):
        if start >= reach:
            out.append((start, end, term))
            reach = end
    return out


def _scan(df: DataFrame, keys: list[str], text: str, terms: list[str], rows: Callable) -> Iterator[pa.RecordBatch]:
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast((hash(tuple(terms)), terms))  # CHARACTERS at most
    schema = ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys), "start int, end int, term string"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = _automaton(shared)
        for batch in (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256)):
            row, found = [], []
            for i, t in enumerate(batch.column(text).to_pylist()):
                m = rows(a, t) if t else []
                row += [i] * len(m)
                found += m
            at = pa.array(row, pa.int32())
            start, end, term = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in keys), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(term, pa.string())], [*keys, "start", "end", "term"])

    return df.select(*keys, text).mapInArrow(work, schema)


def matches(df: DataFrame, keys: list[str], text: str, terms: DataFrame, mode: str = "all", most: int = CHARACTERS) -> DataFrame:
    """(keys, start, end, term) of the terms in each text: 'all' occurrences, those that 'count' for their term (not overlapping),
    the 'maximal' ones (inside no longer one), or the 'leftmost' longest, not overlapping."""
    rows = {"all": every, "count": counted, "maximal": lambda a, t: maximal(every(a, t)), "leftmost": lambda a, t: leftmost(every(a, t))}[mode]
    parts = lexicons(terms, most)
    if not parts:
        return df.select(*keys, F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("").alias("term")).limit(0)
    if len(parts) == 1 or mode in ("all", "count"):
        out = None
        for part in parts:
            x = _scan(df, keys, text, part, rows)
            out = x if out is None else out.union(x)
        return out
    # several automata: what each of them leaves of one text meets again
    out, choose = None, {"maximal": maximal, "leftmost": leftmost}[mode]
    for part in parts:
        x = _scan(df, keys, text, part, lambda a, t: maximal(every(a, t)) if mode == "maximal" else every(a, t))
        out = x if out is None else out.union(x)
    kind = "array<struct<start:int,end:int,term:string>>"
    chosen = F.udf(lambda found: choose([tuple(m) for m in found]), kind)
    met = out.groupBy(*keys).agg(F.collect_list(F.struct("start", "end", "term")).alias("m"))
    return met.select(*keys, F.explode(chosen("m")).alias("m")).select(*keys, "m.*")


def counts(df: DataFrame, keys: list[str], texts: list[str], terms: DataFrame, most: int = CHARACTERS) -> DataFrame:
    """(keys, term, a count for each text column) of terms that any of the columns holds: occurrences that don't overlap."""
    out = None
    for c in texts:
        x = matches(df, keys, c, terms, "count", most).select(*keys, "term", *[F.lit(int(c == o)).alias(f"n_{o}") for o in texts])
        out = x if out is None else out.union(x)
    return out.groupBy(*keys, "term").agg(*[F.sum(f"n_{c}").alias(f"n_{c}") for c in texts])


def replaced(df: DataFrame, text: str, table: DataFrame, most: int = CHARACTERS) -> DataFrame:
    """FN-09: df with the leftmost longest of the table's terms (term, canonical) replaced in a text column; rules of one term: the least.

    The table is a rule table of at most `most` characters; a longer one is refused.
    """
    rules = dict(table.groupBy("term").agg(F.min("canonical").alias("canonical")).where(F.length("term") > 0).limit(most + 1).collect())
    if sum(map(len, rules)) + sum(len(v or "") for v in rules.values()) > most:
        raise ValueError(f"a table of replacements has {most} characters at most")
    if not rules:
        return df
    terms = sorted(rules)
    shared = df.sparkSession.sparkContext.broadcast((hash(tuple(terms)), terms, rules))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, to = _automaton(shared), shared.value[2]

        def one(t: str | None) -> str | None:
            if not t:
                return t
            out, last = [], 0
            for start, end, term in leftmost(every(a, t)):
                out += [t[last:start], to[term] or ""]
                last = end
            return "".join([*out, t[last:]])

        for batch in (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256)):
            at = batch.schema.get_field_index(text)
            yield pa.RecordBatch.from_arrays([pa.array([one(t) for t in c.to_pylist()], pa.string()) if i == at else c for i, c in enumerate(batch.columns)], batch.schema.names)

    return df.mapInArrow(work, df.schema)


def topic_scores(df: DataFrame, key: str, title: str, body: str, rules: DataFrame) -> DataFrame:
    """JON-07: (key, topic, score) of topics (topic, keywords, context_any, excluded_any, minimum): 6 for every hit in a title, 1 in a
    body; a topic with contexts needs one of them in the body, one with an excluded term in title or body is out."""
    role = lambda name, kind: rules.select("topic", "minimum", F.explode(name).alias("term"), F.lit(kind).alias("role"))
    r = role("keywords", "keyword").union(role("context_any", "context")).union(role("excluded_any", "excluded")).distinct()
    hit = counts(df, [key], [title, body], r.select("term"))
    per = hit.join(r, "term").groupBy(key, "topic").agg(
        F.sum(F.when(F.col("role") == "keyword", 6 * F.col(f"n_{title}") + F.col(f"n_{body}")).otherwise(0)).alias("score"),
        F.max((F.col("role") == "context") & (F.col(f"n_{body}") > 0)).alias("in_context"),
        F.max(F.col("role") == "excluded").alias("out"),
        F.max("minimum").alias("minimum"),
    )
    gated = rules.select("topic", (F.size("context_any") > 0).alias("gated"))
    return per.join(gated, "topic").where((F.col("score") >= F.col("minimum")) & ~F.col("out") & (~F.col("gated") | F.col("in_context"))).select(key, "topic", "score")
