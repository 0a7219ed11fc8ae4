"""Question understanding over conversations, benchmark items and documents (FN-*, QU-*, JON-11/16/23, WIN-14/15, SRT-13)."""

from __future__ import annotations

from pyspark.sql import functions as F

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


KEY = ["conv_id", "turn"]
MODES = Rules("modes", "term string, mode string, weight double, decisive boolean", [("tion", "overview", 0.5, False), ("with", "practice", 2.0, False), ("that", "diagnosis", 1.0, False), ("from", "practice", 1.0, False), ("nicht", "boundary", 0.5, True), ("für", "boundary", 0.5, True)])
OUTPUTS = {"practice": (["with "], []), "diagnosis": (["from ", "von "], []), "comparison": (["than ", "que "], ["that ", "pour "])}
MARKERS, CONTRASTS = ["from", "nicht", "pour", "sin"], ["and", "und", "et"]
LETTERS = "à-öø-ÿ"
STOP = ["the", "of", "êe", "üü"]
AXES = [("side", "front", "ing"), ("side", "back", "inger"), ("side", "back", "ment"), ("court", "left", "tion"), ("court", "right", "ation"), ("stage", "late", "able"), ("stage", "early", "ther"), ("stage", "late", "there")]
IMPLIED = [("side", "back", "grip", "reverse"), ("court", "right", "stage", "late"), ("stage", "late", "level", "high"), ("grip", "reverse", "level", "low")]
GAPS = Rules("gaps", "rule int, before string, after string, max_gap int, implies string", [(1, "than", "that", 12, "compare"), (2, "the", "tion", 6, "name"), (3, "ing", "the", 20, "act"), (4, "der", "ung", 30, "thing")])
SYMPTOMS = [("ther", "reach"), ("there", "balance"), ("ation", "timing"), ("tion", "grip"), ("ung", "swing"), ("eau", "step")]
NEGATORS = ["no", "un", "in "]
ACTORS, PRONOUNS = ["the", "der", "la"], ["it", "es", "que"]

_T = "t AS (SELECT conv_id, turn, lower(text) AS text FROM conversations)"
_D = "t AS (SELECT doc_id, lower(text) AS text FROM documents)"


def _turns(spark, d):
    return table(spark, d, "conversations").select(*KEY, F.lower("text").alias("text"))


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", F.lower("text").alias("text"))


def _list(xs):
    return "[" + ", ".join(f"'{x}'" for x in xs) + "]"


def _any(xs, text="text"):
    return "(" + " OR ".join(f"contains({text}, '{x}')" for x in xs) + ")" if xs else "false"


@query(f"""WITH {MODES.sql}, {_T}, per AS (SELECT conv_id, turn, mode, sum(weight) AS score, max(CAST(decisive AS INTEGER)) AS d FROM t JOIN modes ON contains(text, term) GROUP BY ALL),
r AS (SELECT *, row_number() OVER w AS k, lead(score) OVER w AS nxt FROM per WINDOW w AS (PARTITION BY conv_id, turn ORDER BY d DESC, score DESC, mode)),
b AS (SELECT conv_id, turn, CASE WHEN d = 1 OR score - coalesce(nxt, 0) >= 1.5 THEN mode ELSE 'general' END AS mode, round(score, 4) AS score FROM r WHERE k = 1)
SELECT conv_id, turn, coalesce(mode, 'general') AS mode, coalesce(score, 0.0) AS score FROM t LEFT JOIN b USING (conv_id, turn)""")
def answer_mode(spark, d):
    return Q.answer_mode(_turns(spark, d), MODES.df(spark), KEY, 1.5, "general")


@query(f"WITH {_T} SELECT conv_id, turn, CASE " + " ".join(f"WHEN {_any(a)} AND NOT {_any(b)} THEN '{n}'" for n, (a, b) in OUTPUTS.items()) + " ELSE 'coaching_answer' END AS output FROM t")
def requested_output(spark, d):
    return _turns(spark, d).select(*KEY, Q.requested_output(F.col("text"), OUTPUTS, "coaching_answer").alias("output"))


@query(rf"""WITH {_T}, s AS (SELECT conv_id, turn, text, list_filter(list_transform(regexp_extract_all(text, '(?:^|[\s,.;])(?:{'|'.join(MARKERS)})\s+([^,.;\n]+)', 1), lambda s: trim(regexp_replace(s || ' ', '\s(?:{'|'.join(CONTRASTS)})\s.*$', ''))), lambda s: s <> '') AS scopes FROM t)
SELECT conv_id, turn, CAST(len(scopes) AS INTEGER) AS n_scopes, array_to_string(scopes, '|') AS scopes, md5(trim(regexp_replace(text, '(^|[\s,.;])(?:{'|'.join(MARKERS)})\s+[^,.;\n]+', '\1', 'g'))) AS rest FROM s WHERE len(scopes) > 0""")
def negative_scopes(spark, d):
    s = _turns(spark, d).select(*KEY, "text", Q.negative_scopes(F.col("text"), MARKERS, CONTRASTS).alias("scopes")).where(F.size("scopes") > 0)
    return s.select(*KEY, F.size("scopes").alias("n_scopes"), F.array_join("scopes", "|").alias("scopes"), F.md5(Q.without_scopes(F.col("text"), MARKERS).cast("binary")).alias("rest"))


_GRAM = lambda k: f"flatten(list_transform(list_filter(runs, lambda r: length(r) >= {k}), lambda r: list_transform(range(1, length(r) - {k} + 2), lambda i: substr(r, i, {k}))))"


@query(f"""WITH {_D}, r AS (SELECT doc_id, regexp_extract_all(text, '([a-z0-9]{{2,}})', 1) AS words, list_filter(regexp_extract_all(text, '([{LETTERS}]+)', 1), lambda r: length(r) >= 2) AS runs FROM t),
s AS (SELECT doc_id, list_sort(list_filter(list_distinct(words || list_filter(runs, lambda r: length(r) <= 6) || {_GRAM(2)} || {_GRAM(3)} || {_GRAM(4)}), lambda x: NOT list_contains({_list(STOP)}, x))) AS s FROM r)
SELECT doc_id, CAST(len(s) AS INTEGER) AS n_shards, md5(array_to_string(s, ',')) AS shards_md5 FROM s""")
def fallback_shards(spark, d):
    s = _docs(spark, d).select("doc_id", F.sort_array(Q.shards(F.col("text"), STOP, LETTERS)).alias("s"))
    return s.select("doc_id", F.size("s").alias("n_shards"), F.md5(F.array_join("s", ",").cast("binary")).alias("shards_md5"))


@query(r"""WITH c AS (SELECT conv_id, turn, unnest(regexp_split_to_array(lower(text), '[.;!?\n]+')) AS s FROM conversations), p AS (SELECT conv_id, turn, s, string_split(s, ' and ') AS parts FROM c WHERE trim(s) <> ''),
q AS (SELECT conv_id, turn, CASE WHEN len(list_filter(parts, lambda x: NOT contains(x, 'th'))) = 0 THEN parts ELSE [s] END AS parts FROM p), u AS (SELECT conv_id, turn, unnest(parts) AS clause FROM q)
SELECT conv_id, turn, count(*) AS n_clauses, count(*) FILTER (WHERE contains(clause, 'th')) AS n_pointing, max(length(clause)) AS longest FROM u GROUP BY 1, 2""")
def feedback_clauses(spark, d):
    """FN-18: hard ends first; a contrast splits only where every part points at something."""
    c = _turns(spark, d).select(*KEY, F.explode(F.split("text", r"[.;!?\n]+")).alias("s")).where("trim(s) <> ''")
    parts = F.split("s", " and ")
    c = c.select(*KEY, F.explode(F.when(F.forall(parts, lambda x: F.contains(x, F.lit("th"))), parts).otherwise(F.array("s"))).alias("clause"))
    return c.groupBy(*KEY).agg(F.count("*").alias("n_clauses"), F.count_if(F.contains("clause", F.lit("th"))).alias("n_pointing"), F.max(F.length("clause")).cast("long").alias("longest"))


@query(r"""WITH r AS (SELECT page_id, list_distinct(list_transform(regexp_extract_all(url || ' ' || html, '[^0-9]0*([1-9][0-9]{0,8})', 1), lambda x: CAST(x AS BIGINT))) AS refs FROM pages)
SELECT page_id, CAST(len(refs) AS INTEGER) AS n_refs, CAST(list_min(refs) AS BIGINT) AS least, CAST(list_max(refs) AS BIGINT) AS most FROM r""")
def reference_ids(spark, d):
    """FN-19: numbers without leading zeros, each once."""
    refs = F.array_distinct(F.transform(F.regexp_extract_all(F.concat_ws(" ", "url", "html"), F.lit(r"[^0-9]0*([1-9][0-9]{0,8})"), F.lit(1)), lambda x: x.cast("long")))
    return table(spark, d, "pages").select("page_id", refs.alias("refs")).select("page_id", F.size("refs").alias("n_refs"), F.array_min("refs").alias("least"), F.array_max("refs").alias("most"))


@query("SELECT p_partkey, CASE WHEN p_size % 10 = 5 THEN 30 ELSE p_size END AS minutes, CASE WHEN p_size % 10 = 5 THEN 'half_hour' WHEN p_size % 2 = 0 THEN 'digits' ELSE 'numeral' END AS source FROM part")
def session_minutes(spark, d):
    """FN-20: minutes written in digits, in ideographic numerals or as half an hour, and which it was."""
    one = F.array(*map(F.lit, ["", *"一二三四五六七八九"]))
    n = F.col("p_size")
    tens, ones = F.floor(n / 10).cast("int"), (n % 10).cast("int")
    numeral = F.concat(F.when(tens > 1, F.get(one, tens)).otherwise(""), F.when(tens > 0, "十").otherwise(""), F.get(one, ones))
    said = F.when(n % 10 == 5, "半小时").when(n % 2 == 0, F.concat(n.cast("string"), F.lit("分钟"))).otherwise(F.concat(numeral, F.lit("分钟")))
    x = table(spark, d, "part").select("p_partkey", F.concat(F.lit("练"), said, F.lit("吧")).alias("text"))
    return x.select("p_partkey", *[c.alias(n) for n, c in Q.session_minutes(F.col("text")).items()])


@query(f"""WITH {_T}, m AS (SELECT conv_id, turn, list_filter(['solo', 'pair', 'wall'], lambda s: CASE s WHEN 'solo' THEN {_any(['than ', 'sich '])} WHEN 'pair' THEN {_any(['this ', 'mit '])} ELSE {_any(['pour ', 'les '])} END AND NOT contains(text, 'nicht')) AS m FROM t)
SELECT conv_id, turn, CASE WHEN len(m) = 1 THEN m[1] ELSE 'unknown' END AS setup FROM m""")
def practice_setup(spark, d):
    """FN-21: an enum value if exactly one matches, and no negation."""
    kinds = {"solo": ["than ", "sich "], "pair": ["this ", "mit "], "wall": ["pour ", "les "]}
    t = F.col("text")
    m = F.array_compact(F.array(*[F.when(Q.any_of(t, v) & ~F.contains(t, F.lit("nicht")), k) for k, v in kinds.items()]))
    return _turns(spark, d).select(*KEY, F.when(F.size(m) == 1, m[0]).otherwise("unknown").alias("setup"))


_HITS = lambda terms, base, key: f"""p AS (SELECT {key}, text, unnest(range(1, length(text) + 1)) AS i FROM {base}), h AS (SELECT {key}, term, i - 1 AS s, i - 1 + length(term) AS e FROM p, (VALUES {', '.join(f"('{t}')" for t in terms)}) w(term) WHERE substr(text, i, length(term)) = term)"""
_AXV = f"""{_T}, {_HITS(sorted({a[2] for a in AXES}), 't', 'conv_id, turn')}, ax(axis, value, term) AS (VALUES {', '.join(str(a) for a in AXES)}), x AS (SELECT * FROM h JOIN ax USING (term)),
av AS (SELECT DISTINCT conv_id, turn, axis, value FROM x WHERE NOT EXISTS (SELECT 1 FROM x o WHERE o.conv_id = x.conv_id AND o.turn = x.turn AND o.axis = x.axis AND o.value <> x.value AND o.s <= x.s AND o.e >= x.e AND o.e - o.s > x.e - x.s))"""


def _axis(spark, d):
    return Q.axis_values(_turns(spark, d), KEY, "text", AXES, spark)


@query(f"WITH {_AXV} SELECT conv_id, turn, axis, value FROM av")
def axis_values(spark, d):
    return _axis(spark, d)


def _implied_sql():
    out, last = [f"i0 AS (SELECT conv_id, turn, axis, value, 'text' AS source FROM av)"], "i0"
    for k, (a, v, ta, tv) in enumerate(IMPLIED, 1):
        out.append(f"i{k} AS (SELECT * FROM {last} UNION ALL SELECT DISTINCT conv_id, turn, '{ta}', '{tv}', 'implied' FROM {last} x WHERE axis = '{a}' AND value = '{v}' AND NOT EXISTS (SELECT 1 FROM {last} o WHERE o.conv_id = x.conv_id AND o.turn = x.turn AND o.axis = '{ta}'))")
        last = f"i{k}"
    return ", ".join(out) + f" SELECT * FROM {last}"


@query(f"WITH {_AXV}, {_implied_sql()}")
def query_constraints(spark, d):
    return Q.implied(_axis(spark, d), IMPLIED, KEY)


_GT = sorted({t for r in GAPS.rows for t in r[1:3]})


@query(f"""WITH {GAPS.sql}, {_T}, {_HITS(_GT, 't', 'conv_id, turn')}, j AS (SELECT b.conv_id, b.turn, rule, implies FROM gaps JOIN h b ON b.term = before JOIN h a ON a.conv_id = b.conv_id AND a.turn = b.turn AND a.term = after AND a.s BETWEEN b.e AND b.e + max_gap)
SELECT conv_id, turn, min(rule) AS rule, arg_min(implies, rule) AS implies, count(*) AS n FROM j GROUP BY 1, 2""")
def action_sequence(spark, d):
    return Q.ordered_gap(Q.occurrences(_turns(spark, d), KEY, "text", _GT), GAPS.df(spark), KEY)


INTENTS = Rules("intents", "intent string, term string", [("compare", "than"), ("compare", "that"), ("act", "with"), ("act", "from"), ("name", "this")])


@query(f"""WITH {INTENTS.sql}, {_T}, g AS (SELECT intent, count(*) AS of FROM intents GROUP BY 1), m AS (SELECT conv_id, turn, intent, count(*) AS n FROM t JOIN intents ON contains(text, term) GROUP BY ALL)
SELECT conv_id, turn, intent, of - coalesce(n, 0) AS missing, coalesce(n, 0) > 0 AS touched FROM t CROSS JOIN g LEFT JOIN m USING (conv_id, turn, intent)""")
def required_intents(spark, d):
    """QU-05: of every required intent, how many of its terms a question lacks."""
    t, rules = _turns(spark, d), INTENTS.df(spark)
    has = {i: [r[1] for r in INTENTS.rows if r[0] == i] for i in dict.fromkeys(r[0] for r in INTENTS.rows)}
    miss = lambda terms: sum((F.when(F.contains("text", F.lit(x)), 0).otherwise(1) for x in terms), F.lit(0)).cast("long")
    each = F.array(*[F.struct(F.lit(i).alias("intent"), miss(ts).alias("missing"), (miss(ts) < len(ts)).alias("touched")) for i, ts in has.items()])
    return t.select(*KEY, F.explode(each).alias("x")).select(*KEY, "x.*")


_FRAME = {"excluded": ["nicht", "from "], "symptom": ["ation", "heit"], "scenario": ["with ", "mit ", "avec "], "level": ["able", "lich"]}


@query(f"WITH {_T} SELECT conv_id, turn, " + ", ".join(f"array_to_string(list_filter({_list(v)}, lambda x: contains(text, x)), '|') AS {k}" for k, v in _FRAME.items()) + f", CASE " + " ".join(f"WHEN {_any(a)} AND NOT {_any(b)} THEN '{n}'" for n, (a, b) in OUTPUTS.items()) + " ELSE 'coaching_answer' END AS output FROM t")
def intent_frame(spark, d):
    """QU-02: what a question excludes and names, and the output it asks for."""
    found = lambda v: F.array_join(F.filter(F.array(*map(F.lit, v)), lambda x: F.contains("text", x)), "|")
    return _turns(spark, d).select(*KEY, *[found(v).alias(k) for k, v in _FRAME.items()], Q.requested_output(F.col("text"), OUTPUTS, "coaching_answer").alias("output"))


AMBIGUOUS = Rules("ambiguous", "id string, term string, resolver string", [("court", "tion", "ment"), ("court", "tion", "able"), ("grip", "ing ", "ings"), ("step", "eau", "eaux")])


@query(f"WITH {AMBIGUOUS.sql}, {_T} SELECT DISTINCT conv_id, turn, id FROM t JOIN ambiguous a ON contains(text, a.term) WHERE NOT EXISTS (SELECT 1 FROM ambiguous r WHERE r.id = a.id AND contains(text, r.resolver))")
def query_ambiguities(spark, d):
    t, rules = _turns(spark, d), AMBIGUOUS.df(spark)
    triggers = Q.meets(t, rules).select(*KEY, "id").distinct()
    return Q.unless(triggers, Q.meets(t, rules, term="resolver"), [*KEY, "id"])


CORRECT = Rules("correct", "wrong string, right string", [("thth", "th"), ("inin", "in"), ("eaueau", "eau"), ("chch", "ch")])


@query(f"WITH {CORRECT.sql}, {_T} SELECT conv_id, turn, wrong, \"right\", CAST((length(text) - length(replace(text, wrong, ''))) // length(wrong) AS BIGINT) AS n FROM t JOIN correct ON contains(text, wrong)".replace("correct(wrong, right)", 'correct(wrong, "right")'))
def terminology_corrections(spark, d):
    """QU-17: words of a dictionary that a question uses, with what they should be."""
    x = Q.meets(_turns(spark, d), CORRECT.df(spark), term="wrong")
    return x.select(*KEY, "wrong", "right", F.floor((F.length("text") - F.length(F.replace("text", F.col("wrong"), F.lit("")))) / F.length("wrong")).alias("n"))


_HYP = r"(?:^|\s)(?:this|der|les|con)\s+([a-zà-ÿ ,]{3,60})"


@query(rf"""WITH {_T}, x AS (SELECT conv_id, turn, flatten(list_transform(regexp_extract_all(text, '{_HYP}', 1), lambda s: string_split(s, ','))) AS p FROM t),
y AS (SELECT conv_id, turn, list_filter(list_transform(p, lambda s: trim(regexp_replace(trim(s), '\s(of|in|de)$', ''))), lambda s: s <> '') AS p FROM x), z AS (SELECT conv_id, turn, list_filter(p, lambda s, i: list_position(p, s) = i) AS p FROM y)
SELECT conv_id, turn, 'H' || i AS id, p[i] AS hypothesis FROM (SELECT conv_id, turn, p, unnest(range(1, len(p) + 1)) AS i FROM z)""")
def user_hypotheses(spark, d):
    h = _turns(spark, d).select(*KEY, F.posexplode(Q.hypotheses(F.col("text"), _HYP, ",", r"\s(of|in|de)$")).alias("i", "hypothesis"))
    return h.select(*KEY, F.concat(F.lit("H"), F.col("i") + 1).alias("id"), "hypothesis")


@query(f"""WITH {_T}, {_HITS([s for s, _ in SYMPTOMS], 't', 'conv_id, turn')}, n AS (SELECT conv_id, turn, term, s, e, text FROM h JOIN t USING (conv_id, turn)),
g AS (SELECT * FROM n WHERE NOT {_any(NEGATORS, 'substr(text, greatest(1, s - 3), least(s, 4))')}), k AS (SELECT DISTINCT conv_id, turn, term FROM g x WHERE NOT EXISTS (SELECT 1 FROM g o WHERE o.conv_id = x.conv_id AND o.turn = x.turn AND o.s <= x.s AND o.e >= x.e AND o.e - o.s > x.e - x.s)),
m(term, mechanism) AS (VALUES {', '.join(str(s) for s in SYMPTOMS)}), r AS (SELECT conv_id, turn, term, mechanism, row_number() OVER (PARTITION BY conv_id, turn ORDER BY length(term) DESC, term) AS i, count(*) OVER (PARTITION BY conv_id, turn) AS n FROM k JOIN m USING (term))
SELECT conv_id, turn, n AS n_symptoms, term AS longest, mechanism FROM r WHERE i = 1""")
def observed_symptoms(spark, d):
    """QU-19, SRT-13: symptoms that aren't negated nor inside longer ones; the mechanism of the longest."""
    t = _turns(spark, d)
    hits = Q.not_negated(Q.occurrences(t.select(*KEY, "text"), [*KEY, "text"], "text", [s for s, _ in SYMPTOMS]), NEGATORS, 4)
    cover = hits.select(*KEY, F.col("start").alias("s2"), F.col("end").alias("e2"), F.explode(F.sequence("start", F.col("end") - 1)).alias("at"))
    inside = hits.withColumn("at", F.col("start")).join(cover, [*KEY, "at"]).where("e2 >= end and e2 - s2 > end - start").select(*KEY, "term", "start").distinct()
    kept = hits.join(inside, [*KEY, "term", "start"], "left_anti").select(*KEY, "term").distinct()
    m = kept.join(F.broadcast(spark.createDataFrame(SYMPTOMS, "term string, mechanism string")), "term")
    return m.groupBy(*KEY).agg(F.count("*").alias("n_symptoms"), F.min(F.struct((-F.length("term")).alias("l"), "term", "mechanism")).alias("m")).select(*KEY, "n_symptoms", F.col("m.term").alias("longest"), "m.mechanism")


_SEP = r"[.;!?\n]+"


@query(rf"""WITH w0 AS (SELECT conv_id, turn, regexp_split_to_array(trim(regexp_replace(lower(text), '{_SEP}', ' | ', 'g')), '\s+') AS ws FROM conversations), w1 AS (SELECT conv_id, turn, unnest(ws) AS word, unnest(range(0, len(ws))) AS pos FROM w0), w AS (SELECT * FROM w1 WHERE word <> ''),
a AS (SELECT *, sum(CAST(word = '|' AS INTEGER)) OVER o AS sent, last_value(CASE WHEN word IN ({_list(ACTORS)[1:-1]}) THEN word END IGNORE NULLS) OVER o AS last FROM w WINDOW o AS (PARTITION BY conv_id, turn ORDER BY pos ROWS UNBOUNDED PRECEDING)),
b AS (SELECT *, CASE WHEN word IN ({_list(ACTORS)[1:-1]}) THEN word WHEN word IN ({_list(PRONOUNS)[1:-1]}) THEN coalesce(last, 'someone') END AS mark FROM a),
c AS (SELECT *, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY conv_id, turn, sent ORDER BY pos ROWS UNBOUNDED PRECEDING), 'nobody') AS actor FROM b),
e AS (SELECT *, CAST(coalesce(lag(sent || ':' || actor) OVER (PARTITION BY conv_id, turn ORDER BY pos), '') <> sent || ':' || actor AS INTEGER) AS new FROM c WHERE word <> '|'),
f AS (SELECT *, sum(new) OVER (PARTITION BY conv_id, turn ORDER BY pos ROWS UNBOUNDED PRECEDING) AS segment FROM e)
SELECT conv_id, turn, CAST(segment AS BIGINT) AS segment, actor, count(*) AS n_words, md5(string_agg(word, ' ' ORDER BY pos)) AS words FROM f GROUP BY conv_id, turn, segment, actor""")
def actor_runs(spark, d):
    return Q.actor_segments(_turns(spark, d), KEY, ACTORS, PRONOUNS, _SEP).withColumn("words", F.md5(F.col("words").cast("binary")))


@query(rf"""WITH s AS ({{runs}}), r AS (SELECT conv_id, turn, actor, segment FROM s WHERE actor NOT IN ('nobody', 'someone') AND n_words >= 3), l AS (SELECT conv_id, turn, arg_max(actor, segment) AS target FROM r GROUP BY 1, 2),
n AS (SELECT conv_id, turn, count(DISTINCT actor) AS actors, sum(n_words) FILTER (WHERE actor = 'nobody') AS unowned FROM s GROUP BY 1, 2) SELECT conv_id, turn, actors, CAST(coalesce(unowned, 0) AS BIGINT) AS unowned, coalesce(target, 'nobody') AS target FROM n LEFT JOIN l USING (conv_id, turn)""".replace("{runs}", ORACLES["actor_runs"]))
def actor_context(spark, d):
    """QU-14/16: the last actor whose segment asks for something is the target."""
    s = Q.actor_segments(_turns(spark, d), KEY, ACTORS, PRONOUNS, _SEP)
    asks = ~F.col("actor").isin("nobody", "someone") & (F.col("n_words") >= 3)
    g = s.groupBy(*KEY).agg(F.countDistinct("actor").alias("actors"), F.sum(F.when(F.col("actor") == "nobody", F.col("n_words")).otherwise(0)).alias("unowned"), F.max_by("actor", F.when(asks, F.col("segment"))).alias("target"))
    return g.select(*KEY, "actors", "unowned", F.coalesce("target", F.lit("nobody")).alias("target"))


TARGETS = Rules("targets", "rule int, symptom string, incoming string, response string, action string", [(1, "ation", "the", "with", "return"), (2, "ther", "that", "for", "drop"), (3, "ung", "der", "und", "lift"), (4, "ion", "le", "et", "clear")])


@query(f"WITH {TARGETS.sql}, {_T}, j AS (SELECT conv_id, turn, rule, action FROM t JOIN targets ON contains(text, symptom) AND contains(text, incoming) AND contains(text, response)) SELECT conv_id, turn, min(rule) AS rule, arg_min(action, rule) AS action, count(*) AS n_rules FROM j GROUP BY 1, 2")
def target_action(spark, d):
    """QU-15: a symptom, what came in and what was done imply the action; the first rule wins."""
    j = _turns(spark, d).join(F.broadcast(TARGETS.df(spark)), F.contains("text", "symptom") & F.contains("text", "incoming") & F.contains("text", "response"))
    return j.groupBy(*KEY).agg(F.min(F.struct("rule", "action")).alias("m"), F.count("*").alias("n_rules")).select(*KEY, "m.*", "n_rules")


@query("""WITH RECURSIVE u AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, contains(lower(text), 'with') OR contains(lower(text), 'nicht') AS done FROM conversations WHERE role = 'user'),
f AS (SELECT conv_id, 0 AS k, 'open' AS state, 0 AS turns, '' AS digest FROM (SELECT DISTINCT conv_id FROM u) UNION ALL
SELECT f.conv_id, CAST(u.k AS INTEGER), CASE WHEN state <> 'open' THEN state WHEN turns >= 2 THEN 'expired' WHEN done THEN 'resolved' ELSE 'open' END, turns + CASE WHEN state = 'open' AND turns < 2 THEN 1 ELSE 0 END, CASE WHEN state = 'open' AND turns < 2 THEN sha256(digest || text) ELSE digest END FROM f JOIN u ON u.conv_id = f.conv_id AND u.k = f.k + 1)
SELECT conv_id, state, turns, digest FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY k DESC) AS i FROM f) WHERE i = 1""")
def continuation_state(spark, d):
    u = table(spark, d, "conversations").where("role = 'user'")
    done = F.contains(F.lower("text"), F.lit("with")) | F.contains(F.lower("text"), F.lit("nicht"))
    return Q.continuation(u, "conv_id", "turn", done, 2)


@query(rf"""WITH {_AXV}, u AS (SELECT conv_id, turn, unnest(regexp_split_to_array(text, '[.;!?\n]+')) AS u FROM t), v AS (SELECT DISTINCT conv_id, turn, trim(u) AS unit FROM u WHERE trim(u) <> ''), g AS (SELECT conv_id, turn, list_sort(list(DISTINCT value)) AS terms FROM av GROUP BY 1, 2)
SELECT DISTINCT conv_id, turn, md5(unit) AS unit, md5(trim(array_to_string(list_filter(coalesce(terms, []), lambda x: NOT contains(unit, x)) || [unit], ' '))) AS planned FROM v LEFT JOIN g USING (conv_id, turn)""")
def planned_units(spark, d):
    t = _turns(spark, d)
    units = t.select(*KEY, F.explode(F.split("text", r"[.;!?\n]+")).alias("unit")).select(*KEY, F.trim("unit").alias("unit")).where("unit <> ''").distinct()
    p = Q.units_with_constraints(units, _axis(spark, d).select(*KEY, F.col("value").alias("term")), KEY)
    return p.select(*KEY, *[F.md5(F.col(c).cast("binary")).alias(c) for c in ("unit", "planned")])


BOUNDARY = {"medical": ["schmerz", "heit"], "official": ["gericht", "keit"], "personal": ["@", "moi"], "news": ["cion", "ción"], "buying": ["$$", "ción "]}


@query(f"WITH {_T}, b AS (SELECT conv_id, turn, CASE " + " ".join(f"WHEN {_any(v)} THEN '{k}'" for k, v in BOUNDARY.items()) + " ELSE 'none' END AS boundary FROM t) SELECT conv_id, turn, boundary, CASE boundary WHEN 'none' THEN 'cite' WHEN 'news' THEN 'cite_dated' ELSE 'no_citation' END AS citation, boundary IN ('medical', 'official') AS must_state FROM b")
def boundary_class(spark, d):
    """QU-11: five classes by priority, the citation policy of each, and whether a statement is required."""
    c = F
    for k, v in BOUNDARY.items():
        c = c.when(Q.any_of(F.col("text"), v), k)
    b = _turns(spark, d).select(*KEY, c.otherwise("none").alias("boundary"))
    return b.select(*KEY, "boundary", F.when(F.col("boundary") == "none", "cite").when(F.col("boundary") == "news", "cite_dated").otherwise("no_citation").alias("citation"), F.col("boundary").isin("medical", "official").alias("must_state"))


STRATEGY = ["boundary", "systematic", "multi_issue", "diagnostic", "focused", "scenario", "evidence_check"]


@query(f"""WITH {_T}, f AS (SELECT conv_id, turn, text, len(list_filter(regexp_split_to_array(text, '[.;!?\\n]+'), lambda x: trim(x) <> '')) AS units FROM t)
SELECT conv_id, turn, CASE WHEN {_any(['heit', 'keit'])} THEN 'boundary' WHEN length(text) > 900 THEN 'systematic' WHEN units > 6 THEN 'multi_issue' WHEN contains(text, 'ation') THEN 'diagnostic' WHEN contains(text, 'that ') THEN 'focused' WHEN {_any(['with ', 'avec '])} THEN 'scenario' ELSE 'evidence_check' END AS strategy FROM f""")
def plan_strategy(spark, d):
    """QU-06: seven strategies, the first that holds."""
    t = F.col("text")
    units = F.size(F.filter(F.split(t, r"[.;!?\n]+"), lambda x: F.trim(x) != ""))
    tests = [Q.any_of(t, ["heit", "keit"]), F.length(t) > 900, units > 6, F.contains(t, F.lit("ation")), F.contains(t, F.lit("that ")), Q.any_of(t, ["with ", "avec "])]
    c = F
    for name, test in zip(STRATEGY, tests, strict=False):
        c = c.when(test, name)
    return _turns(spark, d).select(*KEY, c.otherwise(STRATEGY[-1]).alias("strategy"))


GROUPS = Rules("groups", "member string, grp int", [("ation", 1), ("ieux", 1), ("ung", 1), ("ther", 2), ("lich", 2)])
CONCEPTS = Rules("concepts", "concept string", [("ation",), ("therein",), ("lich",), ("eau",), ("ing",)])


@query(f"""WITH {GROUPS.sql}, {CONCEPTS.sql}, w AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS term FROM benchmark), t AS (SELECT term, concept FROM w, concepts WHERE length(term) >= 3 AND (contains(term, concept) OR contains(concept, term))
UNION SELECT term, concept FROM w JOIN groups a ON a.member = term JOIN groups b ON a.grp = b.grp JOIN concepts ON concept = b.member) SELECT term, concept FROM t""")
def term_concepts(spark, d):
    """JON-23: a term is a concept's if either holds the other, or if both are in one group of equivalents."""
    w = table(spark, d, "benchmark").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("term")).distinct()
    c, g = CONCEPTS.df(spark), GROUPS.df(spark)
    near = w.where(F.length("term") >= 3).join(F.broadcast(c), F.contains("term", "concept") | F.contains("concept", "term"))
    same = w.join(F.broadcast(g), F.col("term") == F.col("member")).select("term", "grp").join(F.broadcast(g), "grp").join(F.broadcast(c), F.col("concept") == F.col("member"))
    return near.select("term", "concept").union(same.select("term", "concept")).distinct()


@query(f"""WITH {_D}, {_HITS(['there', 'ther', 'ation', 'eau', 'ung'], 't', 'doc_id')}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s, e DESC, term) AS k FROM h) SELECT doc_id, term, CAST(s AS INTEGER) AS start FROM r WHERE k = 1""")
def primary_term(spark, d):
    """WIN-15: the first term of a text; of those that start together the longest."""
    h = Q.occurrences(_docs(spark, d), ["doc_id"], "text", ["there", "ther", "ation", "eau", "ung"])
    return h.groupBy("doc_id").agg(F.min(F.struct("start", (-F.length("term")).alias("l"), "term")).alias("m")).select("doc_id", "m.term", "m.start")
