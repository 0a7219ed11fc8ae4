"""Evidence decisions, contexts, contracts, audits and feedback over questions and documents (EV-*, CT-*, FB-*, JON-13/15/17/18, RT-06)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenquery.functions import text as T
from lumenquery.operators import evidence as E
from lumenquery.operators import matching as M
from lumenquery.operators import questions as Q
from lumenquery.sources.tables import table

from .literals import Rules

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    """Registers a query, with the SQL of the same rows where there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


ENDS = r"[.;!?\n]+"
_WORDS = lambda c: f"list_distinct(regexp_extract_all(lower({c}), '([a-z]{{7,}})', 1))"
_MATCH = f"""q0 AS (SELECT item_id, [lower(text)] || list_filter(regexp_split_to_array(lower(text), '{ENDS}'), lambda s: trim(s) <> '') AS us FROM benchmark), q1 AS (SELECT item_id, unnest(us) AS t, unnest(range(0, len(us))) AS unit FROM q0),
q AS (SELECT item_id, unit, unnest({_WORDS('t')}) AS concept FROM q1), sz AS (SELECT item_id, unit, count(*) AS n FROM q GROUP BY 1, 2), dw AS (SELECT doc_id, unnest({_WORDS('text')}) AS concept FROM documents),
m0 AS (SELECT item_id, unit, doc_id, count(*) AS matched FROM dw JOIN q USING (concept) GROUP BY ALL), m1 AS (SELECT m0.*, n AS of_, round(matched / n, 4) AS coverage FROM m0 JOIN sz USING (item_id, unit)),
m AS (SELECT *, rank() OVER (PARTITION BY item_id, unit ORDER BY coverage DESC, doc_id) AS rank FROM m1)"""


def _matches(spark, d):
    units = M.question_units(table(spark, d, "benchmark"), "item_id", "text", ENDS)
    return M.matches(units, table(spark, d, "documents").select("doc_id", "text"), "item_id")


_FLAGS = {"full": "matched = of_", "direct": "coverage >= 0.8 OR (coverage >= 0.5 AND rank <= 3)", "expansion": "coverage >= 0.5 AND rank <= 8", "component": "rank <= 12", "substantive": "matched >= 2", "direct_question": "unit = 0 AND matched = of_"}


@query(f"WITH {_MATCH} SELECT item_id, CAST(unit AS INTEGER) AS unit, doc_id, coverage, " + ", ".join(f"({v}) AS \"{k}\"" for k, v in _FLAGS.items()) + " FROM m")
def match_quality(spark, d):
    return _matches(spark, d).select("item_id", "unit", "doc_id", "coverage", *[c.alias(n) for n, c in M.match_flags().items()])


_DECIDE = f"""{_MATCH}, lv AS (SELECT item_id, doc_id, min(CASE WHEN {_FLAGS['direct_question']} THEN 0 WHEN {_FLAGS['full']} THEN 1 WHEN rank <= 12 AND matched >= 2 THEN 2 WHEN {_FLAGS['expansion']} THEN 3 ELSE 5 END) AS l FROM m GROUP BY 1, 2),
dc AS (SELECT item_id, lv.doc_id, {M.DECISIONS}[1 + least(l, CASE WHEN r.doc_id IS NOT NULL THEN 4 ELSE 5 END)] AS decision FROM lv LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) r ON r.doc_id = lv.doc_id)"""


def _decisions(spark, d):
    return M.concept_decision(_matches(spark, d), table(spark, d, "labels").where("quality = 1").select("doc_id").distinct(), "item_id")


@query(f"WITH {_DECIDE} SELECT item_id, doc_id, decision FROM dc")
def concept_decision(spark, d):
    return _decisions(spark, d)


@query(f"WITH {_MATCH}, x AS (SELECT DISTINCT item_id, doc_id, concept FROM dw JOIN q USING (concept) WHERE unit = 0), n AS (SELECT item_id, n FROM sz WHERE unit = 0) SELECT item_id, doc_id, count(*) AS covered, md5(string_agg(concept, ',' ORDER BY concept)) AS concepts, round(count(*) / any_value(n), 4) AS share FROM x JOIN n USING (item_id) GROUP BY 1, 2")
def concept_coverage(spark, d):
    """EV-11: which of a question's concepts each document has."""
    u = M.question_units(table(spark, d, "benchmark"), "item_id", "text", ENDS).where("unit = 0")
    n = u.groupBy("item_id").agg(F.count("*").alias("n"))
    words = table(spark, d, "documents").select("doc_id", F.explode(M.concepts(F.col("text"))).alias("concept"))
    g = words.join(u, "concept").groupBy("item_id", "doc_id").agg(F.array_sort(F.collect_set("concept")).alias("c")).join(n, "item_id")
    return g.select("item_id", "doc_id", F.size("c").cast("long").alias("covered"), F.md5(F.array_join("c", ",").cast("binary")).alias("concepts"), F.round(F.size("c") / F.col("n"), 4).alias("share"))


FOCUS, PHRASES = [["ation", "tion"], ["lich", "heit", "with "], ["eau", "ing "]], ["station", "that with "]
_FT = "lower(text)"
for _p in PHRASES:
    _FT = f"replace({_FT}, '{_p}', ' ')"


@query(f"WITH t AS (SELECT doc_id, {_FT} AS t FROM documents), g AS (SELECT doc_id, " + " + ".join("CAST((" + " OR ".join(f"contains(t, '{x}')" for x in g) + ") AS INTEGER)" for g in FOCUS) + f" AS groups_met FROM t) SELECT doc_id, groups_met, groups_met = {len(FOCUS)} AS all_met FROM g")
def focus_groups(spark, d):
    n, every = M.focus(F.lower("text"), FOCUS, PHRASES)
    return table(spark, d, "documents").select("doc_id", n.alias("groups_met"), every.alias("all_met"))


@query("""WITH t AS (SELECT doc_id, lower(split_part(text, chr(10), 1)) AS a, lower(text) AS b FROM documents) SELECT doc_id, CASE WHEN contains(a, 'ation') THEN 'direct_primary' WHEN contains(b, 'ation') THEN 'direct_structured' WHEN contains(a, 'grip') OR contains(a, 'ung') THEN 'mechanism_primary' WHEN contains(b, 'grip') OR contains(b, 'ung') THEN 'mechanism_structured' ELSE 'none' END AS decision FROM t""")
def symptom_decision(spark, d):
    """EV-08: a symptom in the title, in the text, else its mechanism there."""
    t = table(spark, d, "documents").select("doc_id", F.lower(T.first_line(F.col("text"))).alias("a"), F.lower("text").alias("b"))
    has = lambda c, ts: T.contains_any(F.col(c), ts)
    return t.select("doc_id", F.when(has("a", ["ation"]), "direct_primary").when(has("b", ["ation"]), "direct_structured").when(has("a", ["grip", "ung"]), "mechanism_primary").when(has("b", ["grip", "ung"]), "mechanism_structured").otherwise("none").alias("decision"))


_FAIL = {
    "required_axis_missing": ("NOT (contains(b, 'ing') OR contains(b, 'ment') OR contains(b, 'ung'))", lambda: ~T.contains_any(F.col("b"), ["ing", "ment", "ung"])),
    "comparison_one_sided": ("contains(b, 'tion') <> contains(b, 'able')", lambda: F.contains("b", F.lit("tion")) != F.contains("b", F.lit("able"))),
    "derived_condition_conflict": ("lang = 'fr' AND contains(b, 'lich')", lambda: (F.col("lang") == "fr") & F.contains("b", F.lit("lich"))),
    "action_scope_missing": ("NOT contains(a, 'th') AND contains(b, 'with ')", lambda: ~F.contains("a", F.lit("th")) & F.contains("b", F.lit("with "))),
    "non_target_actor": ("contains(b, 'the the') AND NOT contains(b, 'that')", lambda: F.contains("b", F.lit("the the")) & ~F.contains("b", F.lit("that"))),
}


@query("WITH t AS (SELECT doc_id, lang, lower(split_part(text, chr(10), 1)) AS a, lower(text) AS b FROM documents) " + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS code FROM t WHERE {s}" for k, (s, _) in _FAIL.items()))
def support_failures(spark, d):
    """EV-03: five predicates, each a row where it fails."""
    t = table(spark, d, "documents").select("doc_id", "lang", F.lower(T.first_line(F.col("text"))).alias("a"), F.lower("text").alias("b"))
    return E.violations(t, ["doc_id"], {k: c() for k, (_, c) in _FAIL.items()})


AXES = {"side": {"front": "ing ", "back": "ment"}, "court": {"left": "ation", "right": "able"}, "stage": {"late": "lich", "early": "eau"}}
_VALS = lambda c: "list_filter([" + ", ".join(f"CASE WHEN contains({c}, '{t}') THEN '{a}:{v}' END" for a, vs in AXES.items() for v, t in vs.items()) + "], lambda x: x IS NOT NULL)"


def _values(c):
    return F.array_compact(F.array(*[F.when(F.contains(c, F.lit(t)), F.lit(f"{a}:{v}")) for a, vs in AXES.items() for v, t in vs.items()]))


_SCOPE = f"""sc0 AS (SELECT doc_id, lang, {_VALS('lower(split_part(text, chr(10), 1))')} AS title, {_VALS('lower(text)')} AS body, CASE WHEN doc_id % 97 = 0 THEN ['side:front'] ELSE CAST([] AS VARCHAR[]) END AS override, CASE WHEN source = 'src0' THEN ['court:left'] ELSE CAST([] AS VARCHAR[]) END AS category FROM documents),
sc AS (SELECT doc_id, lang, CASE WHEN len(override) > 0 THEN override WHEN len(title) > 0 THEN title WHEN len(category) > 0 THEN category ELSE body END AS scope, CASE WHEN len(override) > 0 THEN 'override' WHEN len(title) > 0 THEN 'primary' WHEN len(category) > 0 THEN 'category' WHEN len(body) > 0 THEN 'structured' ELSE 'none' END AS source FROM sc0)"""


def _scopes(spark, d):
    x = table(spark, d, "documents")
    none = F.array().cast("array<string>")
    value, name = M.prioritised(
        ("override", F.when(F.col("doc_id") % 97 == 0, F.array(F.lit("side:front"))).otherwise(none)), ("primary", _values(F.lower(T.first_line(F.col("text"))))),
        ("category", F.when(F.col("source") == "src0", F.array(F.lit("court:left"))).otherwise(none)), ("structured", _values(F.lower("text"))),
    )
    return x.select("doc_id", "lang", value.alias("scope"), name.alias("source"))


@query(f"WITH {_SCOPE} SELECT doc_id, array_to_string(scope, ',') AS scope, source FROM sc")
def scope_precedence(spark, d):
    """EV-01: override, then title, then category, then the whole text."""
    return _scopes(spark, d).select("doc_id", F.array_join("scope", ",").alias("scope"), "source")


_ASKED = {"en": ["side:front", "court:left"], "de": ["stage:late"], "fr": ["stage:early", "side:back"]}
_ASKED_SQL = "CASE lang " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _ASKED.items()) + " ELSE CAST([] AS VARCHAR[]) END"


@query(f"WITH {_SCOPE}, x AS (SELECT doc_id, scope, {_ASKED_SQL} AS asked FROM sc), y AS (SELECT doc_id, asked, list_filter(scope, lambda v: NOT list_contains(list_transform(asked, lambda a: split_part(a, ':', 1)), split_part(v, ':', 1))) AS extra FROM x) SELECT doc_id, array_to_string(extra, ',') AS extra, CAST(2 * len(extra) + CASE WHEN list_contains(extra, 'court:right') THEN 5 ELSE 0 END AS INTEGER) AS penalty FROM y")
def unrequested_scope(spark, d):
    """EV-04: values of axes that nobody asked for, and what they cost in rank."""
    c = F
    for k, v in _ASKED.items():
        c = c.when(F.col("lang") == k, F.array(*map(F.lit, v)))
    x = _scopes(spark, d).withColumn("axes", F.transform(c.otherwise(F.array().cast("array<string>")), lambda a: F.split_part(a, F.lit(":"), F.lit(1))))
    extra = F.filter("scope", lambda v: ~F.array_contains(F.col("axes"), F.split_part(v, F.lit(":"), F.lit(1))))
    return x.select("doc_id", extra.alias("e")).select("doc_id", F.array_join("e", ",").alias("extra"), (2 * F.size("e") + F.when(F.array_contains("e", "court:right"), 5).otherwise(0)).alias("penalty"))


@query(f"""WITH {_DECIDE}, {_SCOPE}, x AS (SELECT item_id, dc.doc_id, decision, len(scope) AS n FROM dc JOIN sc USING (doc_id))
SELECT decision, decision IN ('exact_question', 'exact_query_unit') AND n <= 2 AS core, CASE WHEN decision = 'none' THEN 'no_claim' WHEN n = 0 THEN 'general' WHEN n = 1 THEN 'single_scope' ELSE 'bounded' END AS claim_scope, count(*) AS n, count(DISTINCT item_id) AS items FROM x GROUP BY 1, 2, 3""")
def claim_scope(spark, d):
    """EV-10: core or supporting, and how far a claim may reach."""
    x = _decisions(spark, d).join(_scopes(spark, d), "doc_id").withColumn("n", F.size("scope"))
    core = F.col("decision").isin("exact_question", "exact_query_unit") & (F.col("n") <= 2)
    scope = F.when(F.col("decision") == "none", "no_claim").when(F.col("n") == 0, "general").when(F.col("n") == 1, "single_scope").otherwise("bounded")
    return x.groupBy("decision", core.alias("core"), scope.alias("claim_scope")).agg(F.count("*").alias("n"), F.countDistinct("item_id").alias("items"))


CUES = {"key": (["tion", "lich"], 5), "coverage": (["th", "de"], 3), "error": (["nicht", "no "], 3), "cue": (["with", "mit", "con"], 4)}
_SENT = f"s0 AS (SELECT doc_id, regexp_split_to_array(lower(text), '{ENDS}') AS ss FROM documents), s1 AS (SELECT doc_id, unnest(ss) AS s, unnest(range(0, len(ss))) AS pos FROM s0), s AS (SELECT * FROM s1 WHERE trim(s) <> '')"
_HITS = lambda ts: " + ".join(f"(length(s) - length(replace(s, '{t}', ''))) // {len(t)}" for t in ts)


@query(f"WITH {_SENT}, r AS (" + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS role, {n} AS most, pos, {_HITS(ts)} AS score FROM s WHERE {_HITS(ts)} > 0" for k, (ts, n) in CUES.items()) + """), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, role ORDER BY score DESC, pos) AS i FROM r), p AS (SELECT * FROM k WHERE i <= most),
v AS (SELECT * FROM p WHERE role <> 'coverage' OR NOT EXISTS (SELECT 1 FROM p o WHERE o.doc_id = p.doc_id AND o.role = 'key' AND o.pos = p.pos)) SELECT doc_id, role, count(*) AS n, CAST(sum(score) AS BIGINT) AS score, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS at FROM v GROUP BY 1, 2""")
def automatic_note(spark, d):
    """EV-12: the best sentences of four roles, up to 5, 3, 3 and 4; what is key isn't coverage too."""
    s = table(spark, d, "documents").select("doc_id", F.posexplode(F.split(F.lower("text"), ENDS)).alias("pos", "s")).where("trim(s) <> ''")
    role = F.array(*[F.struct(F.lit(k).alias("role"), F.lit(n).alias("most"), T.keyword_hits(F.col("s"), ts).alias("score")) for k, (ts, n) in CUES.items()])
    r = s.select("doc_id", "pos", F.explode(role).alias("r")).select("doc_id", "pos", "r.*").where("score > 0")
    p = r.withColumn("i", F.row_number().over(Window.partitionBy("doc_id", "role").orderBy(F.desc("score"), "pos"))).where("i <= most")
    key = p.where("role = 'key'").select("doc_id", "pos", F.lit("coverage").alias("role"))
    v = p.join(key, ["doc_id", "pos", "role"], "left_anti")
    at = F.array_join(F.transform(F.array_sort(F.collect_list("pos")), lambda x: x.cast("string")), ",")
    return v.groupBy("doc_id", "role").agg(F.count("*").alias("n"), F.sum("score").alias("score"), at.alias("at"))


@query("""SELECT d.doc_id, CASE WHEN l.toxic = 1 THEN 'excluded' WHEN l.quality = 0 THEN 'low_value' WHEN n_chars < 200 THEN 'needs_review' WHEN l.quality = 1 THEN 'ready' ELSE 'automatic' END AS status,
CASE WHEN l.quality = 1 AND coalesce(l.toxic, 0) = 0 THEN 'reviewed' WHEN l.quality IS NULL AND n_chars >= 2000 THEN 'medium' WHEN l.quality IS NULL THEN 'low' ELSE 'none' END AS confidence FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def record_status(spark, d):
    """EV-13: status and confidence from the label, the gates on length, and what a person decided."""
    x = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    q, t, n = F.col("quality"), F.coalesce("toxic", F.lit(0)), F.col("n_chars")
    status = F.when(t == 1, "excluded").when(q == 0, "low_value").when(n < 200, "needs_review").when(q == 1, "ready").otherwise("automatic")
    sure = F.when((q == 1) & (t == 0), "reviewed").when(q.isNull() & (n >= 2000), "medium").when(q.isNull(), "low").otherwise("none")
    return x.select("doc_id", status.alias("status"), sure.alias("confidence"))


@query("""WITH o AS (SELECT doc_id, md5(text) AS h, TIMESTAMP '2024-01-01 00:00:00' AS at FROM documents WHERE doc_id % 5 <> 0), n AS (SELECT doc_id, md5(CASE WHEN doc_id % 3 = 0 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 7 <> 0)
SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'insert' WHEN n.doc_id IS NULL THEN 'retired' WHEN o.h = n.h THEN 'kept' ELSE 'update' END AS action, CASE WHEN o.h = n.h OR n.doc_id IS NULL THEN o.at ELSE TIMESTAMP '2024-06-01 00:00:00' END AS updated_at FROM o FULL JOIN n ON o.doc_id = n.doc_id""")
def knowledge_merge(spark, d):
    """EV-14: a new build meets the last one; rows of equal content keep their time."""
    x = table(spark, d, "documents").select("doc_id", "text")
    at = lambda t: F.to_timestamp_ntz(F.lit(t))
    old = x.where("doc_id % 5 <> 0").select("doc_id", F.md5(F.col("text").cast("binary")).alias("h"), F.lit(1).alias("was"))
    new = x.where("doc_id % 7 <> 0").select("doc_id", F.md5(F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).cast("binary")).alias("h2"), F.lit(1).alias("now"))
    j = old.join(new, "doc_id", "full")
    same = F.col("h") == F.col("h2")
    action = F.when(F.col("was").isNull(), "insert").when(F.col("now").isNull(), "retired").when(same, "kept").otherwise("update")
    return j.select("doc_id", action.alias("action"), F.when(same | F.col("now").isNull(), at("2024-01-01 00:00:00")).otherwise(at("2024-06-01 00:00:00")).alias("updated_at"))


_EV = f"{_DECIDE}, {_SCOPE}, ev AS (SELECT item_id, doc_id, split_part(v, ':', 1) AS axis, split_part(v, ':', 2) AS value FROM (SELECT item_id, dc.doc_id, unnest(scope) AS v FROM dc JOIN sc USING (doc_id) WHERE decision <> 'none'))"


def _evidence(spark, d):
    x = _decisions(spark, d).where("decision <> 'none'").join(_scopes(spark, d), "doc_id").select("item_id", F.col("doc_id").alias("item"), F.explode("scope").alias("v"))
    return x.select("item_id", "item", F.split_part("v", F.lit(":"), F.lit(1)).alias("axis"), F.split_part("v", F.lit(":"), F.lit(2)).alias("value"))


@query(f"WITH {_EV}, b AS (SELECT item_id, axis, value, count(DISTINCT doc_id) AS items, min(doc_id) AS \"first\" FROM ev GROUP BY 1, 2, 3), n AS (SELECT *, count(*) OVER (PARTITION BY item_id, axis) AS n_values FROM b) SELECT * FROM n WHERE n_values >= 2 OR axis = 'court'")
def diagnostic_branches(spark, d):
    return M.branches(_evidence(spark, d), "item_id", ["court"])


@query(f"""WITH {_DECIDE}, g AS (SELECT item_id, count(*) AS n, count(*) FILTER (WHERE decision IN ('exact_question', 'exact_query_unit')) AS exact, min(doc_id) AS lead FROM dc GROUP BY 1),
e AS (SELECT item_id, CASE WHEN exact > 0 THEN 'sufficient' WHEN n > 5 THEN 'partial' ELSE 'insufficient' END AS state, n, exact, lead FROM g)
SELECT item_id, state, sha256('{{"exact":' || exact || ',"item_id":' || item_id || ',"lead":' || lead || ',"n":' || n || ',"state":"' || state || '"}}') AS contract, (length(state) + 40) AS packet FROM e""".replace(", (length(state) + 40) AS packet", ""))
def turn_contract(spark, d):
    """CT-05/06: what an answer may rest on, as a projection with a digest that a later packet must match."""
    g = _decisions(spark, d).groupBy("item_id").agg(F.count("*").alias("n"), F.count_if(F.col("decision").isin("exact_question", "exact_query_unit")).alias("exact"), F.min("doc_id").alias("lead"))
    state = F.when(F.col("exact") > 0, "sufficient").when(F.col("n") > 5, "partial").otherwise("insufficient")
    return g.withColumn("state", state).select("item_id", "state", M.digest("item_id", "state", "n", "exact", "lead").alias("contract"))


@query(f"""WITH {_DECIDE}, x AS (SELECT item_id, doc_id, decision FROM dc WHERE decision <> 'none'), e AS (SELECT x.item_id, x.doc_id, decision, d.n_chars, list_position({M.DECISIONS}, decision) AS l FROM x JOIN documents d ON d.doc_id = x.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY l, n_chars DESC, doc_id) AS place FROM e) SELECT item_id, 'V' || place AS label, doc_id, decision FROM r WHERE place <= 3""")
def claim_evidence(spark, d):
    """JON-17, WIN-05: the three best documents of each question, labelled V1 to V3."""
    claims = _decisions(spark, d).where("decision <> 'none'")
    level = F.array_position(F.array(*map(F.lit, M.DECISIONS)), F.col("decision"))
    top = M.top_evidence(claims, table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id", ["item_id"], [level, F.desc("n_chars"), "doc_id"], 3)
    return top.select("item_id", F.concat(F.lit("V"), "place").alias("label"), "doc_id", "decision")


@query(f"""WITH {_SCOPE}, a AS (SELECT doc_id, lang, scope FROM sc WHERE len(scope) > 0), c(claim, lang, have) AS (VALUES (1, 'en', ['side:front', 'court:left']), (2, 'en', ['side:front', 'side:back', 'court:left', 'court:right', 'stage:late', 'stage:early']), (3, 'de', ['stage:late', 'side:front']), (4, 'fr', ['stage:early', 'side:back']))
SELECT claim, count(*) AS atoms, min(doc_id) AS "first", max(len(scope)) AS widest FROM a JOIN c ON a.lang = c.lang AND len(list_filter(scope, lambda x: NOT list_contains(have, x))) = 0 GROUP BY 1""")
def claim_atoms(spark, d):
    """JON-18, SET-05: atoms of a claim's language whose scope lies within its constraints."""
    atoms = _scopes(spark, d).where(F.size("scope") > 0)
    claims = spark.createDataFrame([(1, "en", ["side:front", "court:left"]), (2, "en", ["side:front", "side:back", "court:left", "court:right", "stage:late", "stage:early"]), (3, "de", ["stage:late", "side:front"]), (4, "fr", ["stage:early", "side:back"])], "claim int, lang string, have array<string>")
    return M.scoped(atoms, F.broadcast(claims), ["lang"], "scope", "have").groupBy("claim").agg(F.count("*").alias("atoms"), F.min("doc_id").alias("first"), F.max(F.size("scope")).cast("long").alias("widest"))


_SIG = f"""sg AS (SELECT conv_id, turn, list_sort({_WORDS('text')}) AS c, md5(array_to_string(list_sort({_WORDS('text')}), ',')) AS sig FROM conversations)"""


@query(f"WITH {_SIG} SELECT conv_id, turn, CAST(len(c) AS INTEGER) AS n_features, sig AS signature, count(*) OVER (PARTITION BY sig) AS same FROM sg")
def feedback_signature(spark, d):
    """FB-05: the features of a question as one signature, and how many share it."""
    c = F.array_sort(M.concepts(F.col("text")))
    s = table(spark, d, "conversations").select("conv_id", "turn", F.size(c).alias("n_features"), F.md5(F.array_join(c, ",").cast("binary")).alias("signature"))
    return s.join(s.groupBy("signature").agg(F.count("*").alias("same")), "signature")


_PAIR = f"""u AS (SELECT item_id, unnest({_WORDS('text')}) AS c FROM benchmark), n AS (SELECT item_id, count(*) AS n FROM u GROUP BY 1), v AS (SELECT DISTINCT conv_id, turn, c FROM (SELECT conv_id, turn, unnest({_WORDS('text')}) AS c FROM conversations)),
vn AS (SELECT conv_id, turn, count(*) AS n FROM v GROUP BY 1, 2), pr AS (SELECT item_id, conv_id, turn, count(*) AS i FROM u JOIN v USING (c) GROUP BY ALL), js AS (SELECT item_id, conv_id, turn, i / (n.n + vn.n - i) AS sim FROM pr JOIN n USING (item_id) JOIN vn USING (conv_id, turn))"""


def _similar(spark, d):
    u = table(spark, d, "benchmark").select("item_id", M.concepts(F.col("text")).alias("cs"))
    v = table(spark, d, "conversations").select("conv_id", "turn", M.concepts(F.col("text")).alias("cs"))
    left, right = u.select("item_id", F.size("cs").alias("n"), F.explode("cs").alias("c")), v.select("conv_id", "turn", F.size("cs").alias("m"), F.explode("cs").alias("c"))
    p = right.join(left, "c").groupBy("item_id", "conv_id", "turn").agg(F.count("*").alias("i"), F.first("n").alias("n"), F.first("m").alias("m"))
    return p.select("item_id", "conv_id", "turn", (F.col("i") / (F.col("n") + F.col("m") - F.col("i"))).alias("sim"))


@query(f"WITH {_PAIR} SELECT item_id, count(*) AS n, min(CASE WHEN sim >= 0.05 THEN 0 WHEN sim >= 0.02 THEN 1 ELSE 2 END) AS priority, round(max(sim), 4) AS best FROM js GROUP BY 1")
def reviewed_priorities(spark, d):
    """JON-15: the least priority of any reviewed turn that is like a question; turns are met through shared concepts."""
    s = _similar(spark, d)
    return s.groupBy("item_id").agg(F.count("*").alias("n"), F.min(F.when(F.col("sim") >= 0.05, 0).when(F.col("sim") >= 0.02, 1).otherwise(2)).alias("priority"), F.round(F.max("sim"), 4).alias("best"))


_ADJ = f"""{_PAIR}, w AS (SELECT item_id, conv_id, sim, CASE WHEN turn % 3 = 0 THEN 4.0 WHEN turn % 3 = 1 THEN -2.0 ELSE 90.0 END AS weight FROM js), ad AS (SELECT item_id, round(greatest(-12.0, least(12.0, sum(sim * weight))), 4) AS delta, round(sum(CASE WHEN weight > 0 THEN sim * weight ELSE 0 END), 4) AS positive, round(sum(CASE WHEN weight < 0 THEN -sim * weight ELSE 0 END), 4) AS negative, round(max(sim), 4) AS max_similarity, count(DISTINCT conv_id) AS signals FROM w GROUP BY 1)"""


def _adjust(spark, d):
    w = F.when(F.col("turn") % 3 == 0, 4.0).when(F.col("turn") % 3 == 1, -2.0).otherwise(90.0)
    return M.adjustments(_similar(spark, d).select("item_id", F.col("conv_id").alias("signal"), F.col("sim").alias("similarity"), w.alias("weight")), "item_id", 12.0)


@query(f"WITH {_ADJ} SELECT * FROM ad")
def feedback_adjustments(spark, d):
    return _adjust(spark, d)


@query(f"""WITH {_ADJ}, r AS (SELECT item_id, CASE WHEN item_id % 3 = 0 THEN 'direct' ELSE 'topic_related' END AS tier, CAST(length(text) AS DOUBLE) / 8 AS score FROM benchmark WHERE item_id % 4 <> 1),
l AS (SELECT item_id, 1.5 AS delta, CASE WHEN item_id % 6 = 1 THEN 0.9 ELSE 0.5 END AS max_similarity FROM benchmark WHERE item_id % 2 = 1), t AS (SELECT coalesce(ad.item_id, l.item_id) AS item_id, round(coalesce(ad.delta, 0.0) + coalesce(l.delta, 0.0), 4) AS delta, greatest(coalesce(ad.max_similarity, 0.0), coalesce(l.max_similarity, 0.0)) AS sim FROM ad FULL JOIN l ON ad.item_id = l.item_id),
j AS (SELECT coalesce(r.item_id, t.item_id) AS item_id, tier, score, delta, sim FROM r FULL JOIN t ON r.item_id = t.item_id)
SELECT item_id, CASE WHEN sim >= 0.82 AND delta > 0 THEN 'direct' ELSE coalesce(tier, 'feedback_only') END AS tier, round(coalesce(score, 0.0) + coalesce(delta, 0.0), 4) AS score, score IS NULL AS injected FROM j WHERE tier IS NOT NULL OR (delta > 0 AND item_id % 8 <> 5)""")
def feedback_layers(spark, d):
    b = table(spark, d, "benchmark")
    ranked = b.where("item_id % 4 <> 1").select("item_id", F.when(F.col("item_id") % 3 == 0, "direct").otherwise("topic_related").alias("tier"), (F.length("text").cast("double") / 8).alias("score"))
    local = b.where("item_id % 2 = 1").select("item_id", F.lit(1.5).alias("delta"), F.when(F.col("item_id") % 6 == 1, 0.9).otherwise(0.5).alias("max_similarity"))
    return M.layered(ranked, {"global": _adjust(spark, d), "local": local}, b.where("item_id % 8 <> 5"), "item_id", 0.82)


#: What a turn breaks, by itself or against the turn before it.
_AUDIT = {
    "empty": "length(trim(text)) = 0", "too_long": "length(text) > 600", "too_short": "length(text) < 20", "unknown_role": "role NOT IN ('user', 'assistant')", "role_repeats": "role = prev_role", "starts_with_answer": "turn = 0 AND role = 'assistant'",
    "turn_gap": "turn <> coalesce(prev_turn + 1, 0)", "same_text": "text = prev_text", "no_end_mark": "NOT regexp_matches(text, '[.!?]\\s*$')", "link": "contains(text, 'http')", "mail": "contains(text, '@')", "markup": "regexp_matches(text, '<[a-z]')",
    "code": "contains(text, '$')", "table": "contains(text, ' | ')", "shouting": "regexp_matches(text, '[A-Z]{6,}')", "digits": "regexp_matches(text, '[0-9]{4,}')", "answer_shorter": "role = 'assistant' AND length(text) < length(prev_text)", "question_in_answer": "role = 'assistant' AND contains(text, '?')",
    "many_lines": "length(text) - length(replace(text, chr(10), '')) > 5", "double_space": "contains(text, '  ')", "negation": "contains(lower(text), 'nicht') OR contains(lower(text), ' no ')", "copied_opening": "substr(text, 1, 12) = substr(prev_text, 1, 12)",
}


def _spark_sql(sql: str) -> str:
    return sql.replace("regexp_matches(", "regexp_like(").replace("\\s", "\\\\s").replace("chr(10)", "'\\n'")


@query("WITH c AS (SELECT *, lag(role) OVER w AS prev_role, lag(turn) OVER w AS prev_turn, lag(text) OVER w AS prev_text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) " + " UNION ALL ".join(f"SELECT conv_id, turn, '{k}' AS code FROM c WHERE {v}" for k, v in _AUDIT.items()))
def turn_checks(spark, d):
    """What a turn breaks, by itself or against the turn before it: one row a violation."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, d, "conversations").select("*", *[F.lag(n).over(w).alias(f"prev_{n}") for n in ("role", "turn", "text")])
    return E.violations(c, ["conv_id", "turn"], {k: F.expr(_spark_sql(v)) for k, v in _AUDIT.items()})


@query(f"""WITH {_DECIDE}, g AS (SELECT item_id, list_sort(list(DISTINCT decision)) AS got FROM dc GROUP BY 1), x AS (SELECT b.item_id, CASE WHEN length(text) > 150 THEN ['component'] ELSE ['component', 'expanded'] END AS want, coalesce(got, CAST([] AS VARCHAR[])) AS got FROM benchmark b LEFT JOIN g USING (item_id))
SELECT item_id, 'missing' AS kind, array_to_string(list_filter(want, lambda w: NOT list_contains(got, w)), ',') AS what FROM x WHERE len(list_filter(want, lambda w: NOT list_contains(got, w))) > 0 UNION ALL SELECT item_id, 'forbidden', 'reviewed' FROM x WHERE list_contains(got, 'reviewed') UNION ALL SELECT item_id, 'unequal', CAST(len(got) AS VARCHAR) FROM x WHERE len(got) <> 3""")
def case_mismatches(spark, d):
    """CT-09/10: what was expected of a case against what came: a subset, an exclusion and an equality."""
    got = _decisions(spark, d).groupBy("item_id").agg(F.array_sort(F.collect_set("decision")).alias("got"))
    want = F.when(F.length("text") > 150, F.array(F.lit("component"))).otherwise(F.array(F.lit("component"), F.lit("expanded")))
    x = table(spark, d, "benchmark").select("item_id", want.alias("want")).join(got, "item_id", "left").withColumn("got", F.coalesce("got", F.array().cast("array<string>")))
    rows = F.array_compact(F.array(
        F.when(F.size(F.array_except("want", "got")) > 0, F.struct(F.lit("missing").alias("kind"), F.array_join(F.array_except("want", "got"), ",").alias("what"))),
        F.when(F.array_contains("got", "reviewed"), F.struct(F.lit("forbidden").alias("kind"), F.lit("reviewed").alias("what"))),
        F.when(F.size("got") != 3, F.struct(F.lit("unequal").alias("kind"), F.size("got").cast("string").alias("what"))),
    ))
    return x.select("item_id", F.explode(rows).alias("r")).select("item_id", "r.*")
