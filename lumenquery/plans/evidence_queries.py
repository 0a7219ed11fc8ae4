"""Plans, constraints, audits, feedback, incremental state and evaluation (QU-*, EV-*, CT-*, FB-*, ST-*, AGG-*, GV-*)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenquery.functions import text as T
from lumenquery.operators import evidence as E
from lumenquery.operators import retrieval as R
from lumenquery.operators import similarity as J
from lumenquery.sources.tables import table

from .retrieval_queries import _F as FIELDS_SQL
from .retrieval_queries import _bm25 as bm25_sql
from .retrieval_queries import _fields
from .search_queries import grams
from .text_queries import NORM

RULES = [("the", None, "ther", 1.4, "shard"), ("the", "tion", "here", 0.55, "topic"), ("ing", None, "inger", 1.8, "equivalent"), ("and", None, "ther", 3.5, "original"), ("ment", "que", "amente", 1.0, "directed")]
SEPARATORS = [". ", "\n", ", and "]
AXES = {"court": ["tion", "able"], "side": ["ing", "ment"], "stage": ["lich", "eau", "ado"]}


def _questions(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.lower("text").alias("text"))


def expand_query(spark, d):
    rules = spark.createDataFrame(RULES, "query_term string, suppress_term string, expanded string, weight double, provenance string")
    return E.expand_terms(_questions(spark, d), rules)


def build_lexicon(spark, d):
    """QU-01: union of the rule sources."""
    rules = spark.createDataFrame(RULES, "query_term string, suppress_term string, expanded string, weight double, provenance string")
    words = table(spark, d, "benchmark").select(F.explode(F.split(F.lower("text"), r"[^a-z]+")).alias("term")).where("length(term) >= 9")
    return rules.select(F.col("query_term").alias("term")).union(rules.select("expanded")).union(words).distinct()


def query_plan(spark, d):
    """QU-06/07/08/11: units, boundary, strategy of each question."""
    q = _questions(spark, d)
    u = E.split_units(F.col("text"), SEPARATORS)
    s = E.strategy(F.contains("text", F.lit("idiot")), F.length("text") > 600, F.size("units"), F.contains("text", F.lit("whwh")))
    return q.select("qid", "text", u.alias("units")).select("qid", F.size("units").alias("n_units"), s.alias("strategy"), F.md5(F.array_join("units", "|").cast("binary")).alias("units_md5"))


def constraint_decisions(spark, d):
    """EV-01/02: axis values of a question against those of documents in its language bucket."""
    values = lambda c: F.array_compact(F.array(*[F.when(F.contains(c, F.lit(m)), F.lit(f"{a}:{m}")) for a, ms in AXES.items() for m in ms]))
    t = F.col("text")
    x = table(spark, d, "documents").select("doc_id", values(T.first_line(F.col("text"))).alias("requested"), values(t).alias("found"), F.when(F.col("lang") == "fr", F.array(F.lit("stage:lich"))).otherwise(F.array().cast("array<string>")).alias("suppressed"))
    return x.where(F.size("requested") > 0).select("doc_id", E.constraint_match(F.col("requested"), F.col("found"), F.col("suppressed")).alias("match"))


def selection_decision(spark, d):
    """EV-09/10: ordered reject rules, the first failure wins."""
    x = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    reason = E.first_reason({"unlabelled": F.col("quality").isNull(), "toxic": F.col("toxic") == 1, "low_quality": F.col("quality") == 0, "too_short": F.col("n_chars") < 100, "language": ~F.col("lang").isin("en", "de")})
    return x.select("doc_id", reason.alias("decision"))


def _cases(spark, d):
    """Three questions, ranked; gold: good documents with the term in the title are primary, other good ones required."""
    f = _fields(spark, d)
    good = table(spark, d, "labels").where("quality = 1 and toxic = 0").select("doc_id")
    ranked = gold = None
    for case, term in enumerate(("tion", "thble", "ment")):
        s = R.bm25f(f, {term: 1.0})
        r = R.page(s, [F.desc("bm25"), "doc_id"], 0, 50, 50).select(F.lit(case).alias("case_id"), F.col("doc_id").alias("item"), F.col("pos").alias("rank"))
        g = f.join(good, "doc_id").where(F.contains("body", F.lit(term))).select(F.lit(case).alias("case_id"), F.col("doc_id").alias("item"), F.when(F.contains("title", F.lit(term)), 2).otherwise(1).alias("gain"))
        ranked, gold = (r, g) if ranked is None else (ranked.union(r), gold.union(g))
    return ranked, gold


def ir_metrics(spark, d):
    return E.metrics(*_cases(spark, d), 50)


def baseline_compare(spark, d):
    m = E.metrics(*_cases(spark, d), 50).agg(F.round(F.avg("recall"), 4).alias("recall"), F.round(F.avg("ndcg"), 4).alias("ndcg"), F.round(F.avg("reciprocal_rank"), 4).alias("mrr"))
    values = m.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in ("recall", "ndcg", "mrr")])).alias("v")).select("v.*")
    base = spark.createDataFrame([("recall", 0.01, "at_least", 0.0), ("ndcg", 0.99, "at_least", 0.0), ("mrr", 1.0, "at_most", 0.0), ("absent", 1.0, "equal", 0.0)], "metric string, floor double, direction string, tolerance double")
    return E.compare_baseline(values, base)


def blind_pairs_scores(spark, d):
    """JON-20, SRT-10, AGG-13: pairs with equal roles, one hash bit a pair for the sides, wins and means."""
    c = table(spark, d, "conversations").where("turn in (0, 1)")
    a, b = c.where("turn = 0").select("conv_id", F.length("text").alias("na")), c.where("turn = 1").select("conv_id", F.length("text").alias("nb"))
    p = a.join(b, "conv_id").withColumn("swapped", F.substring(F.md5(F.col("conv_id").cast("string").cast("binary")), 1, 1) < "8")
    left, right = F.when(F.col("swapped"), F.col("nb")).otherwise(F.col("na")), F.when(F.col("swapped"), F.col("na")).otherwise(F.col("nb"))
    return p.groupBy("swapped").agg(F.count_if(left > right).alias("left_wins"), F.count_if(right > left).alias("right_wins"), F.round(F.avg(left), 4).alias("left_mean"))


def audit_violations(spark, d):
    """CT-07/08: units against rules, one row a violation."""
    c = table(spark, d, "conversations")
    return E.violations(c, ["conv_id", "turn"], {"empty_unit": F.length(F.trim("text")) == 0, "too_long": F.length("text") > 400, "no_label": ~F.col("role").isin("user", "assistant", "system"), "system_late": (F.col("role") == "system") & (F.col("turn") > 0), "link": F.contains("text", F.lit("http"))})


def claim_match(spark, d):
    """CT-08, K20: claims to answers by grams of whole texts, above the gate and within the band of the best."""
    claims = table(spark, d, "benchmark").select(F.col("item_id").alias("claim"), T.grams(T.norm(F.col("text")), 4).alias("cg"))
    units = table(spark, d, "conversations").select("conv_id", "turn", "text")
    units = J.dealt(units, ["conv_id", "turn"], claims.count() * units.count()).select("conv_id", "turn", T.grams(T.norm(F.col("text")), 4).alias("ug"))
    s = J.contained(claims, "claim", "cg", units, ["conv_id", "turn"], "ug", E.CLAIM_GATE)
    s = s.withColumn("best", F.max("score").over(Window.partitionBy("conv_id", "turn")))
    return s.where((F.col("score") >= E.CLAIM_GATE) & (F.col("score") >= F.col("best") - E.CLAIM_BAND)).select("claim", "conv_id", "turn", F.round("score", 4).alias("score"))


def roundtrip_grams(spark, d):
    """GV-08: the index's stored grams against those of the texts as they are now; of documents that changed since, how many differ."""
    now = F.when(F.col("doc_id") % 50 == 0, F.concat("text", F.lit(" zzqq"))).otherwise(F.col("text"))
    again = table(spark, d, "documents").select("doc_id", F.explode(T.grams(T.norm(now), 2)).alias("g")).select("doc_id", T.gram_hash(F.col("g")).alias("gram_id"), F.lit(1).alias("now"))
    stored = grams(spark, d).where("channel = 'body'").select("doc_id", "gram_id", F.lit(1).alias("was"))
    x = stored.join(again, ["doc_id", "gram_id"], "full")
    return x.groupBy("doc_id").agg(F.count_if(F.col("was").isNull() | F.col("now").isNull()).alias("differences"), F.count("was").alias("n"))


def feedback_parse(spark, d):
    """FB-01, FN-18/19: clauses of user turns, polarity by cues, references, conflicts."""
    c = table(spark, d, "conversations").where("role = 'user'")
    clause = c.select("conv_id", "turn", F.explode(F.filter(F.split("text", r"[.;!?\n]+"), lambda s: F.trim(s) != "")).alias("clause"))
    pol = F.when(F.contains(F.lower("clause"), F.lit("not ")) | F.contains(F.lower("clause"), F.lit("no ")), "negative").when(F.contains(F.lower("clause"), F.lit("able")) | F.contains(F.lower("clause"), F.lit("ing")), "positive").otherwise("neutral")
    x = clause.select("conv_id", pol.alias("polarity"))
    return x.groupBy("conv_id").agg(F.count_if(F.col("polarity") == "positive").alias("helpful"), F.count_if(F.col("polarity") == "negative").alias("irrelevant"), F.count("*").alias("clauses")).withColumn("conflict", F.expr("helpful > 0 and irrelevant > 0"))


def feedback_similarity(spark, d):
    """JON-14, K9: weighted Jaccards of words, grams and concepts of pairs that share a word, with the strict and loose gates."""
    t = F.lower("text")
    q = table(spark, d, "benchmark").select("item_id", T.grams(T.norm(t), 2).alias("g"), F.array_distinct(F.split(F.trim(t), r"\s+")).alias("w"), F.array_distinct(F.regexp_extract_all(t, F.lit("([a-z]{7,})"), F.lit(1))).alias("c"))
    side = lambda n: q.select(F.col("item_id").alias(n), *[F.col(x).alias(x + n) for x in "gwc"])
    word = lambda n: q.select(F.col("item_id").alias(n), F.explode("w").alias("word"))
    met = word("a").join(word("b"), "word").where("a < b").select("a", "b").distinct()
    j = met.join(side("a"), "a").join(side("b"), "b")
    sim = F.round(0.55 * T.jaccard(F.col("wa"), F.col("wb")) + 0.25 * T.jaccard(F.col("ga"), F.col("gb")) + 0.2 * T.jaccard(F.col("ca"), F.col("cb")), 4)
    return j.select("a", "b", sim.alias("sim")).where("sim > 0.1").withColumn("gate", F.when(F.col("sim") >= 0.72, "strict").when(F.col("sim") >= 0.38, "positive").otherwise("none"))


def snapshot_diff(spark, d):
    """ST-01, JON-04: what the snapshot of the first day doesn't have, classified, with a running count by user."""
    e = table(spark, d, "events")
    day = F.to_timestamp_ntz(F.lit("2024-01-02 00:00:00"))
    known = e.where(F.col("ts") < day).select("user_id", "event_type").distinct()
    new = e.where(F.col("ts") >= day).groupBy("user_id", "event_type").agg(F.min("event_id").alias("first_event")).join(known, ["user_id", "event_type"], "left_anti")
    status = F.when(F.col("event_type") == "error", "excluded").when(F.col("event_type") == "view", "review_pending").otherwise("kept")
    return new.select("user_id", "event_type", "first_event", status.alias("status"), F.row_number().over(Window.partitionBy("user_id").orderBy("first_event")).alias("running"))


def state_machine(spark, d):
    """ST-02/03: attempts, transitions that aren't allowed, terminal state."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    x = table(spark, d, "events").withColumn("before", F.lag("event_type").over(w))
    return x.groupBy("user_id").agg(F.count_if((F.col("before") == "purchase") & (F.col("event_type") == "signup")).alias("invalid"), F.count_if(F.col("event_type") == "error").alias("attempts"), F.max(F.when(F.col("event_type") == "error", F.col("ts"))).alias("last_attempt"))


def keep_timestamp(spark, d):
    """ST-09: the old time where all else is equal."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate")
    new = o.select("o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, F.lit("X")).otherwise(F.col("o_orderstatus")).alias("status"))
    j = new.join(o, "o_orderkey")
    return j.groupBy((F.col("status") == F.col("o_orderstatus")).alias("kept")).agg(F.count("*").alias("n"), F.max(F.when(F.col("status") == F.col("o_orderstatus"), F.col("o_orderdate")).otherwise(F.to_timestamp_ntz(F.lit("2030-01-01 00:00:00")))).alias("latest"))


def size_reduction(spark, d):
    """AGG-12."""
    p = table(spark, d, "pages")
    ratio = 1 - F.length(F.regexp_replace("html", r"<[^>]*>", "")) / F.greatest(F.lit(1), F.length("html"))
    return p.agg(F.round(F.avg(ratio), 4).alias("avg_reduction"), F.round(F.min(ratio), 4).alias("min_reduction"), F.count_if(ratio >= 0.5).alias("passed"))


def link_integrity(spark, d):
    """AGG-08/21."""
    p = table(spark, d, "pages").select(F.regexp_extract("url", r"^[a-z]+://([^/:]+)", 1).alias("host"), "url")
    return p.groupBy("host").agg(F.count("*").alias("total"), F.countDistinct("url").alias("distinct_urls"), (F.count("*") - F.countDistinct("url")).alias("duplicates"))


QUERIES = {f.__name__: f for f in (expand_query, build_lexicon, query_plan, constraint_decisions, selection_decision, ir_metrics, baseline_compare, blind_pairs_scores, audit_violations, claim_match, roundtrip_grams, feedback_parse, feedback_similarity, snapshot_diff, state_machine, keep_timestamp, size_reduction, link_integrity)}

_RULES = "r(query_term, suppress_term, expanded, weight, provenance) AS (VALUES " + ", ".join("(" + ", ".join("CAST(NULL AS VARCHAR)" if v is None else f"'{v}'" if isinstance(v, str) else f"CAST({v} AS DOUBLE)" for v in r) + ")" for r in RULES) + ")"
_UNITS = "lower(text)"
for _s in sorted(SEPARATORS, key=lambda s: (-len(s), s)):
    _UNITS = f"replace({_UNITS}, {'chr(10)' if _s == chr(10) else repr(_s)}, chr(1))"
_G2 = "list_distinct(list_transform(range(1, length({0})), lambda i: substr({0}, i, 2)))"
_JAC = lambda x: f"CASE WHEN len(a.{x}) = 0 OR len(b.{x}) = 0 THEN 0.0 ELSE len(list_intersect(a.{x}, b.{x})) / len(list_distinct(list_concat(a.{x}, b.{x}))) END"
_G4 = "list_distinct(list_transform(range(1, length({0}) - 2), lambda i: substr({0}, i, 4)))"
_AX = lambda c: "list_filter([" + ", ".join(f"CASE WHEN contains({c}, '{m}') THEN '{a}:{m}' END" for a, ms in AXES.items() for m in ms) + "], lambda x: x IS NOT NULL)"
_CASES = {0: "tion", 1: "thble", 2: "ment"}
_METRICS = f"""{FIELDS_SQL}, {', '.join(bm25_sql({t: 1.0}, f's{c}', f'p{c}') for c, t in _CASES.items())},
ranked AS ({' UNION ALL '.join(f"SELECT {c} AS case_id, doc_id AS item, row_number() OVER (ORDER BY bm25 DESC, doc_id) AS rank FROM s{c}" for c in _CASES)}),
gold AS ({' UNION ALL '.join(f"SELECT {c} AS case_id, doc_id AS item, CASE WHEN contains(title, '{t}') THEN 2 ELSE 1 END AS gain FROM f JOIN labels USING (doc_id) WHERE quality = 1 AND toxic = 0 AND contains(body, '{t}')" for c, t in _CASES.items())}),
gi AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY gain DESC, item) AS i FROM gold),
ideal AS (SELECT case_id, count(*) AS expected, sum(gain / log2(i + 1)) FILTER (WHERE i <= 50) AS idcg FROM gi GROUP BY 1),
per AS (SELECT case_id, count(*) AS found, sum(gain / log2(rank + 1)) AS dcg, min(CASE WHEN gain = 2 THEN rank END) AS fp FROM ranked JOIN gold USING (case_id, item) WHERE rank <= 50 GROUP BY 1),
m AS (SELECT case_id, expected, coalesce(found, 0) AS found, round(coalesce(found, 0) / greatest(1, expected), 4) AS recall, round(coalesce(1 / fp, 0), 4) AS reciprocal_rank, round(coalesce(dcg, 0) / idcg, 4) AS ndcg FROM ideal LEFT JOIN per USING (case_id))"""

ORACLES = {
    "expand_query": f"WITH {_RULES}, q AS (SELECT item_id AS qid, lower(text) AS text FROM benchmark), j AS (SELECT * FROM q JOIN r ON contains(text, query_term) AND NOT coalesce(contains(text, suppress_term), false)) SELECT qid, expanded AS term, max(weight) AS weight, arg_max(provenance, weight) AS provenance FROM j GROUP BY 1, 2",
    "build_lexicon": f"WITH {_RULES} SELECT query_term AS term FROM r UNION SELECT expanded FROM r UNION SELECT w FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS w FROM benchmark) WHERE length(w) >= 9",
    "query_plan": rf"""WITH u AS (SELECT item_id AS qid, lower(text) AS text, list_filter(list_transform(string_split({_UNITS}, chr(1)), lambda x: trim(regexp_replace(x, '^[\s.,;]+|[\s.,;]+$', '', 'g'))), lambda x: x <> '') AS units FROM benchmark),
v AS (SELECT qid, text, list_filter(units, lambda x, i: list_position(units, x) = i) AS units FROM u)
SELECT qid, CAST(len(units) AS INTEGER) AS n_units, CASE WHEN contains(text, 'idiot') THEN 'boundary' WHEN length(text) > 600 THEN 'systematic' WHEN len(units) > 1 THEN 'multi_issue' WHEN contains(text, 'whwh') THEN 'diagnostic' ELSE 'focused' END AS strategy, md5(array_to_string(units, '|')) AS units_md5 FROM v""",
    "constraint_decisions": f"""WITH x AS (SELECT doc_id, lang, {_AX("split_part(text, chr(10), 1)")} AS rq, {_AX('text')} AS fd FROM documents)
SELECT doc_id, CASE WHEN lang = 'fr' AND list_contains(rq, 'stage:lich') AND NOT list_has_any(rq, fd) THEN 'conflict' WHEN len(fd) = 0 THEN 'unspecified_support' WHEN NOT list_has_any(rq, fd) THEN 'conflict' WHEN len(list_intersect(rq, fd)) < len(rq) THEN 'partial_support' WHEN len(rq) = 1 AND len(fd) > 1 THEN 'mixed_support' ELSE 'exact' END AS match FROM x WHERE len(rq) > 0""",
    "selection_decision": "SELECT doc_id, CASE WHEN quality IS NULL THEN 'unlabelled' WHEN toxic = 1 THEN 'toxic' WHEN quality = 0 THEN 'low_quality' WHEN n_chars < 100 THEN 'too_short' WHEN lang NOT IN ('en', 'de') THEN 'language' ELSE 'accepted' END AS decision FROM documents LEFT JOIN labels USING (doc_id)",
    "ir_metrics": f"WITH {_METRICS} SELECT * FROM m",
    "baseline_compare": f"""WITH {_METRICS}, v AS (SELECT 'recall' AS metric, round(avg(recall), 4) AS value FROM m UNION ALL SELECT 'ndcg', round(avg(ndcg), 4) FROM m UNION ALL SELECT 'mrr', round(avg(reciprocal_rank), 4) FROM m UNION ALL SELECT 'absent', NULL)
SELECT metric, value, CASE WHEN value IS NULL THEN 'missing' WHEN CASE metric WHEN 'recall' THEN value >= 0.01 WHEN 'ndcg' THEN value >= 0.99 ELSE value <= 1.0 END THEN 'ok' ELSE 'regression' END AS status FROM v""",
    "blind_pairs_scores": """WITH p AS (SELECT a.conv_id, length(a.text) AS na, length(b.text) AS nb, substr(md5(CAST(a.conv_id AS VARCHAR)), 1, 1) < '8' AS swapped FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = 0 AND b.turn = 1),
x AS (SELECT swapped, CASE WHEN swapped THEN nb ELSE na END AS l, CASE WHEN swapped THEN na ELSE nb END AS r FROM p) SELECT swapped, count(*) FILTER (WHERE l > r) AS left_wins, count(*) FILTER (WHERE r > l) AS right_wins, round(avg(l), 4) AS left_mean FROM x GROUP BY 1""",
    "audit_violations": "SELECT conv_id, turn, 'empty_unit' AS code FROM conversations WHERE length(trim(text)) = 0 UNION ALL SELECT conv_id, turn, 'too_long' FROM conversations WHERE length(text) > 400 UNION ALL SELECT conv_id, turn, 'no_label' FROM conversations WHERE role NOT IN ('user', 'assistant', 'system') UNION ALL SELECT conv_id, turn, 'system_late' FROM conversations WHERE role = 'system' AND turn > 0 UNION ALL SELECT conv_id, turn, 'link' FROM conversations WHERE contains(text, 'http')",
    "claim_match": f"""WITH a AS (SELECT item_id AS claim, {_G4.format(NORM.format('text'))} AS c FROM benchmark), b AS (SELECT conv_id, turn, {_G4.format(NORM.format('text'))} AS u FROM conversations), i AS (SELECT claim, conv_id, turn, count(*) AS i FROM (SELECT claim, unnest(c) AS g FROM a) JOIN (SELECT conv_id, turn, unnest(u) AS g FROM b) USING (g) GROUP BY 1, 2, 3),
s AS (SELECT claim, conv_id, turn, i / len(c) AS score FROM i JOIN a USING (claim)), w AS (SELECT *, max(score) OVER (PARTITION BY conv_id, turn) AS best FROM s)
SELECT claim, conv_id, turn, round(score, 4) AS score FROM w WHERE score >= 0.34 AND score >= best - 0.05""",
    "roundtrip_grams": f"""WITH t AS (SELECT doc_id, {NORM.format('text')} AS a, {NORM.format("CASE WHEN doc_id % 50 = 0 THEN text || ' zzqq' ELSE text END")} AS b FROM documents), g AS (SELECT doc_id, {_G2.format('a')} AS ga, {_G2.format('b')} AS gb FROM t)
SELECT doc_id, len(list_filter(ga, lambda x: NOT list_contains(gb, x))) + len(list_filter(gb, lambda x: NOT list_contains(ga, x))) AS differences, len(ga) AS n FROM g WHERE len(ga) + len(gb) > 0""",
    "feedback_parse": r"""WITH c AS (SELECT conv_id, lower(unnest(regexp_split_to_array(text, '[.;!?\n]+'))) AS s FROM conversations WHERE role = 'user'),
p AS (SELECT conv_id, CASE WHEN contains(s, 'not ') OR contains(s, 'no ') THEN 'n' WHEN contains(s, 'able') OR contains(s, 'ing') THEN 'p' ELSE 'u' END AS p FROM c WHERE trim(s) <> ''),
g AS (SELECT conv_id, count(*) FILTER (WHERE p = 'p') AS helpful, count(*) FILTER (WHERE p = 'n') AS irrelevant, count(*) AS clauses FROM p GROUP BY 1) SELECT *, helpful > 0 AND irrelevant > 0 AS conflict FROM g""",
    "feedback_similarity": rf"""WITH q AS (SELECT item_id, lower(text) AS t FROM benchmark), n AS (SELECT item_id, {NORM.format('t')} AS n, list_distinct(regexp_split_to_array(trim(t), '\s+')) AS w, list_distinct(regexp_extract_all(t, '([a-z]{{7,}})', 1)) AS c FROM q), g AS (SELECT item_id, {_G2.format('n')} AS g, w, c FROM n),
s AS (SELECT a.item_id AS a, b.item_id AS b, round(0.55 * {_JAC('w')} + 0.25 * {_JAC('g')} + 0.2 * {_JAC('c')}, 4) AS sim FROM g a JOIN g b ON a.item_id < b.item_id AND list_has_any(a.w, b.w))
SELECT a, b, sim, CASE WHEN sim >= 0.72 THEN 'strict' WHEN sim >= 0.38 THEN 'positive' ELSE 'none' END AS gate FROM s WHERE sim > 0.1""",
    "snapshot_diff": """WITH n AS (SELECT user_id, event_type, min(event_id) AS first_event FROM events e WHERE ts >= TIMESTAMP '2024-01-02 00:00:00' AND NOT EXISTS (SELECT 1 FROM events k WHERE k.ts < TIMESTAMP '2024-01-02 00:00:00' AND k.user_id = e.user_id AND k.event_type = e.event_type) GROUP BY 1, 2)
SELECT user_id, event_type, first_event, CASE event_type WHEN 'error' THEN 'excluded' WHEN 'view' THEN 'review_pending' ELSE 'kept' END AS status, CAST(row_number() OVER (PARTITION BY user_id ORDER BY first_event) AS INTEGER) AS running FROM n""",
    "state_machine": "WITH x AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) SELECT user_id, count(*) FILTER (WHERE b = 'purchase' AND event_type = 'signup') AS invalid, count(*) FILTER (WHERE event_type = 'error') AS attempts, max(CASE WHEN event_type = 'error' THEN ts END) AS last_attempt FROM x GROUP BY 1",
    "keep_timestamp": "WITH j AS (SELECT CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END = o_orderstatus AS kept, o_orderdate FROM orders) SELECT kept, count(*) AS n, max(CASE WHEN kept THEN o_orderdate ELSE TIMESTAMP '2030-01-01 00:00:00' END) AS latest FROM j GROUP BY 1",
    "size_reduction": "WITH r AS (SELECT 1 - CAST(length(regexp_replace(html, '<[^>]*>', '', 'g')) AS DOUBLE) / greatest(1, length(html)) AS r FROM pages) SELECT round(avg(r), 4) AS avg_reduction, round(min(r), 4) AS min_reduction, count(*) FILTER (WHERE r >= 0.5) AS passed FROM r",
    "link_integrity": "SELECT regexp_extract(url, '^[a-z]+://([^/:]+)', 1) AS host, count(*) AS total, count(DISTINCT url) AS distinct_urls, count(*) - count(DISTINCT url) AS duplicates FROM pages GROUP BY 1",
}
