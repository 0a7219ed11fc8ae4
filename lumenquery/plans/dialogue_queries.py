"""Dialogues: who they are about, and what they say to a question (WIN-01, WIN-14, QU-14, QU-16)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenquery.functions import text as T
from lumenquery.operators import contracts as K
from lumenquery.operators import transcript as TR
from lumenquery.operators import transducer as A
from lumenquery.operators.topk import WORDS, words
from lumenquery.sources.tables import table

from .text_queries import NORM

#: Words of the four languages that stand for actors here.
RULES = A.Rules(
    "player",
    {"this": "opponent", "die": "opponent", "les": "opponent", "with": "partner", "und": "partner", "dans": "partner", "for": "coach", "der": "coach", "pour": "coach", "we": "player", "los": "opponent", "con": "partner"},
    frozenset({"opponent", "partner", "coach"}),
    frozenset({"it", "that", "das", "la", "que", "el"}),
    frozenset({"of", "by", "in", "zu", "de", "en"}),
    frozenset({"at", "auf", "et", "un"}),
)


def actor_segments(spark, d):
    """WIN-14: the words of each actor in each turn."""
    s = A.segments(table(spark, d, "conversations"), "conv_id", "turn", "text", RULES)
    return s.groupBy("conv_id", "turn", "actor").agg(F.count("*").alias("segments"), F.sum(F.size("words")).alias("words"), F.count_if("asks").alias("questions"))


def actor_model(spark, d):
    """QU-16: a nested record of each dialogue's actors, and whom its last question is about."""
    return A.model(A.segments(table(spark, d, "conversations"), "conv_id", "turn", "text", RULES), "conv_id", "turn", RULES)


def transcript_evidence(spark, d):
    """WIN-01: of every benchmark item the three dialogues that hold most of its longer words, and their three best windows."""
    segments = table(spark, d, "conversations").select(F.col("conv_id").alias("key"), F.col("turn").alias("pos"), T.norm(F.coalesce("text", F.lit(""))).alias("body"))
    b = table(spark, d, "benchmark")
    terms = b.select(F.col("item_id").alias("question"), F.explode(F.array_distinct(words(F.col("text")))).alias("term")).where(F.col("term").rlike("^[a-z]{5,}$"))
    terms = terms.withColumn("weight", F.length("term") * 0.5)
    return TR.evidence(segments, b.select(F.col("item_id").alias("question"), T.norm(F.col("text")).alias("body")), terms, 3, 3)


CONTRACT = {
    "type": "struct",
    "fields": {
        "conv_id": {"type": "value", "required": True, "least": 0},
        "roles": {"type": "array", "most": 2, "unique": True},
        "askers": {"type": "array", "least": 1},
        "turns": {
            "type": "array", "least": 2, "most": 7, "unique": "role_key",
            "items": {"type": "struct", "fields": {
                "turn": {"type": "value", "required": True, "most": 6},
                "role": {"type": "value", "required": True, "enum": ["user", "assistant"]},
                "role_key": {"type": "value", "required": True},
                "text": {"type": "value", "required": True, "blank": False, "pattern": r"^[^#]*$"},
            }},
        },
    },
    "subset": [("askers", "roles")],
    "disjoint": [("askers", "heads")],
}


def contract_violations(spark, d):
    """FLT-13: every dialogue as a nested record, held against a contract that is data."""
    c = table(spark, d, "conversations")
    turn = F.struct("turn", "role", F.concat_ws("-", "role", F.length("text")).alias("role_key"), "text")
    asker, head = F.when(F.contains("text", F.lit("?")), F.col("role")), F.when(F.col("turn") == 0, F.col("role"))
    x = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"), F.array_sort(F.collect_set("role")).alias("roles"), F.array_sort(F.collect_set(asker)).alias("askers"), F.array_sort(F.collect_set(head)).alias("heads"))
    return K.violations(x, ["conv_id"], CONTRACT).groupBy("conv_id", "path", "code").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (actor_segments, actor_model, transcript_evidence, contract_violations)}

_ROUND = """r{i} AS (SELECT * FROM c x WHERE {free} QUALIFY row_number() OVER (PARTITION BY question, key ORDER BY score DESC, w_start, w_end) = 1)"""
_FREE = "NOT EXISTS (SELECT 1 FROM r{j} y WHERE y.question = x.question AND y.key = x.key AND x.w_start <= y.w_end AND y.w_start <= x.w_end)"

_AT = "'turns[' || p || ']"

ORACLES = {
    "contract_violations": f"""WITH c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS p, role || '-' || length(text) AS rk FROM conversations),
g AS (SELECT conv_id, count(*) AS n, list_distinct(list(role)) AS roles, coalesce(list_distinct(list(role) FILTER (WHERE contains(text, '?'))), []) AS askers, coalesce(list_distinct(list(role) FILTER (WHERE turn = 0)), []) AS heads FROM c GROUP BY 1),
v AS (SELECT conv_id, 'conv_id' AS path, 'too_small' AS code FROM g WHERE conv_id < 0 UNION ALL SELECT conv_id, 'roles', 'too_many' FROM g WHERE len(roles) > 2 UNION ALL SELECT conv_id, 'askers', 'too_few' FROM g WHERE len(askers) < 1
UNION ALL SELECT conv_id, 'turns', 'too_few' FROM g WHERE n < 2 UNION ALL SELECT conv_id, 'turns', 'too_many' FROM g WHERE n > 7 UNION ALL SELECT conv_id, 'heads', 'unknown' FROM g UNION ALL SELECT conv_id, 'askers', 'overlaps_heads' FROM g WHERE list_has_any(askers, heads)
UNION ALL SELECT conv_id, {_AT}.turn', 'too_large' FROM c WHERE turn > 6 UNION ALL SELECT conv_id, {_AT}.role', 'not_in_enum' FROM c WHERE role NOT IN ('user', 'assistant') UNION ALL SELECT conv_id, {_AT}.text', 'blank' FROM c WHERE trim(text) = ''
UNION ALL SELECT conv_id, {_AT}.text', 'pattern' FROM c WHERE contains(text, '#') UNION ALL SELECT conv_id, {_AT}.role_key', 'repeated' FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, rk ORDER BY p) AS k FROM c) WHERE k > 1)
SELECT conv_id, path, code, count(*) AS n FROM v GROUP BY ALL""",
    "transcript_evidence": f"""WITH s AS (SELECT conv_id AS key, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place, {NORM.format("coalesce(text, '')")} AS body FROM conversations),
q AS (SELECT item_id AS question, {NORM.format('text')} AS asked, list_distinct(list_transform(range(1, length({NORM.format('text')})), lambda i: substr({NORM.format('text')}, i, 2))) AS grams FROM benchmark),
t AS (SELECT DISTINCT item_id AS question, w.term AS term, length(w.term) * 0.5 AS weight FROM benchmark, unnest(regexp_extract_all(lower(text), '{WORDS}')) w(term) WHERE regexp_matches(w.term, '^[a-z]{{5,}}$')),
h AS (SELECT DISTINCT question, key, term, weight FROM s JOIN t ON contains(body, term)), f AS (SELECT question, key, round(sum(weight), 4) AS weight FROM h GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY question ORDER BY round(sum(weight), 4) DESC, key) <= 3),
w AS (SELECT DISTINCT key, min(place) OVER o AS w_start, max(place) OVER o AS w_end, array_to_string(list(body) OVER o, '') AS win FROM s WINDOW o AS (PARTITION BY key ORDER BY place ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
v AS (SELECT f.question, f.key, w_start, w_end, win, asked, grams FROM f JOIN w USING (key) JOIN q ON q.question = f.question WHERE win <> ''),
m AS (SELECT v.question, v.key, w_start, w_end, count(*) AS n, sum(weight) AS weight FROM v JOIN t ON t.question = v.question AND contains(win, term) GROUP BY 1, 2, 3, 4),
c AS (SELECT v.question, v.key, v.w_start, v.w_end, CAST(coalesce(n, 0) AS INTEGER) AS n_terms, contains(win, asked) AND asked <> '' AS exact,
len(list_filter(grams, lambda g: contains(win, g))) AS shared, round(CASE WHEN contains(win, asked) AND asked <> '' THEN 100.0 ELSE 0 END + coalesce(weight, 0) + len(list_filter(grams, lambda g: contains(win, g))) / greatest(1, len(grams)) * 25.0, 4) AS score
FROM v LEFT JOIN m USING (question, key, w_start, w_end) WHERE (contains(win, asked) AND asked <> '') OR n > 0 OR len(list_filter(grams, lambda g: contains(win, g))) >= 2),
{_ROUND.format(i=1, free='true')}, {_ROUND.format(i=2, free=_FREE.format(j=1))}, {_ROUND.format(i=3, free=_FREE.format(j=1) + ' AND ' + _FREE.format(j=2))}, u AS (SELECT * FROM r1 UNION ALL SELECT * FROM r2 UNION ALL SELECT * FROM r3)
SELECT question, key, CAST(w_start AS INTEGER) AS w_start, CAST(w_end AS INTEGER) AS w_end, CAST(score AS DOUBLE) AS score, n_terms, exact, CAST(row_number() OVER (PARTITION BY question, key ORDER BY score DESC, w_start, w_end) AS INTEGER) AS rank FROM u""",
}
