"""A lexicon of thousands of terms over whole documents in one pass (JON-06/07, JON-10/11, FN-06/09/10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenquery.operators import automaton as A
from lumenquery.operators.topk import WORDS, words
from lumenquery.sources.tables import table

from .retrieval_queries import _F, _fields


def _lexicon(spark, d, least):
    """(term, value): the words of the benchmark items, plain letters only; a word's value is the first item that has it."""
    w = table(spark, d, "benchmark").select("item_id", F.explode(words(F.col("text"))).alias("term"))
    return w.where((F.length("term") >= least) & F.col("term").rlike("^[a-z]+$")).groupBy("term").agg(F.min("item_id").alias("value"))


def lexicon_counts(spark, d):
    """JON-06, FN-06: documents and occurrences of each term that any document holds."""
    hit = A.counts(_fields(spark, d), ["doc_id"], ["title", "body"], _lexicon(spark, d, 4).select("term"))
    return hit.groupBy("term").agg(F.count("*").alias("df"), F.sum("n_title").alias("in_titles"), F.sum("n_body").alias("in_bodies"))


def lexicon_values(spark, d):
    """JON-10/11: values by their terms in a body, terms inside a longer term left out."""
    terms = _lexicon(spark, d, 4)
    m = A.matches(_fields(spark, d), ["doc_id"], "body", terms.select("term"), "maximal").join(terms, "term")
    return m.groupBy("doc_id", "value").agg(F.count("*").alias("hits"), F.min("start").alias("first"), F.max("end").alias("last"))


def _topics(spark, d):
    """A topic for every benchmark item: its longer words; words of one of which the body must hold one; and words that rule it out."""
    w = table(spark, d, "benchmark").select(F.concat(F.lit("item-"), F.col("item_id")).alias("topic"), F.filter(words(F.col("text")), lambda x: x.rlike("^[a-z]+$")).alias("w"))
    of = lambda low, high: F.array_sort(F.array_distinct(F.filter("w", lambda x: F.length(x).between(low, high))))
    return w.select("topic", of(6, 9).alias("keywords"), of(10, 11).alias("context_any"), of(12, 99).alias("excluded_any"), F.lit(12).alias("minimum"))


def topic_rule_table(spark, d):
    """JON-07: every topic that a document scores enough for."""
    return A.topic_scores(_fields(spark, d), "doc_id", "title", "body", _topics(spark, d))


QUERIES = {f.__name__: f for f in (lexicon_counts, lexicon_values, topic_rule_table)}

_WORD = f"regexp_extract_all(lower(coalesce(text, '')), '{WORDS}')"
_LEX = f"{_F}, bw AS (SELECT item_id, unnest({_WORD}) AS term FROM benchmark), lx AS (SELECT term, min(item_id) AS value FROM bw WHERE length(term) >= 4 AND regexp_matches(term, '^[a-z]+$') GROUP BY 1)"
_N = lambda c: f"(length({c}) - length(replace({c}, term, ''))) // length(term)"

ORACLES = {
    "lexicon_counts": f"WITH {_LEX} SELECT term, count(*) AS df, CAST(sum({_N('title')}) AS BIGINT) AS in_titles, CAST(sum({_N('body')}) AS BIGINT) AS in_bodies FROM f JOIN lx ON contains(body, term) OR contains(title, term) GROUP BY 1",
    "topic_rule_table": f"""WITH {_F}, w AS (SELECT 'item-' || item_id AS topic, list_filter({_WORD}, lambda x: regexp_matches(x, '^[a-z]+$')) AS w FROM benchmark),
t AS (SELECT DISTINCT topic, unnest(w) AS term FROM w), z AS (SELECT topic, term, length(term) AS n FROM t WHERE length(term) >= 6), u AS (SELECT DISTINCT term FROM z),
h AS (SELECT doc_id, term, {_N('title')} AS nt, {_N('body')} AS nb FROM f JOIN u ON contains(body, term) OR contains(title, term)),
s AS (SELECT doc_id, topic, sum(CASE WHEN n <= 9 THEN 6 * nt + nb ELSE 0 END) AS score, bool_or(n BETWEEN 10 AND 11 AND nb > 0) AS ctx, bool_or(n >= 12) AS out_ FROM h JOIN z USING (term) GROUP BY 1, 2),
g AS (SELECT topic, bool_or(n BETWEEN 10 AND 11) AS gated FROM z GROUP BY 1)
SELECT doc_id, topic, CAST(score AS BIGINT) AS score FROM s JOIN g USING (topic) WHERE score >= 12 AND NOT out_ AND (NOT gated OR ctx)""",
}
