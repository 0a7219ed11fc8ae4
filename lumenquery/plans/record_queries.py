"""Records, queues, validators, reports and small projections (PRJ-*, FLT-*, AGG-18..20, WIN-05, SRT-02/08, SET-02, FN-*, FB-02..06, ST-03..07, GV-*, MSC-*, SNK-07/10/11)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenquery.functions import text as T
from lumenquery.operators import records as X
from lumenquery.sources.tables import review_blocks, table

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


def _has(c, terms):
    return T.contains_any(F.col(c) if isinstance(c, str) else c, terms)


# projections


@query("SELECT conv_id, turn, md5(concat_ws(' ', nullif(trim(role), ''), nullif(trim(text), ''))) AS flat, length(concat_ws(' ', nullif(trim(role), ''), nullif(trim(text), ''))) AS n FROM conversations".replace("length(", "CAST(length(").replace(" AS n FROM", " AS INTEGER) AS n FROM"))
def flatten_text(spark, d):
    """FN-03: nested values depth first, joined by spaces; empty ones count for nothing."""
    nested = F.array(F.array(F.col("role")), F.array(F.col("text")))
    flat = X.flat_text(nested)
    return table(spark, d, "conversations").select("conv_id", "turn", flat.alias("f")).select("conv_id", "turn", F.md5(F.col("f").cast("binary")).alias("flat"), F.length("f").alias("n"))


_VIEWS = {"title": "split_part(text, chr(10), 1)", "rest": "substr(text, length(split_part(text, chr(10), 1)) + 2)", "identity": "lang || ' ' || source", "searchable": "text || ' ' || source", "structured": "source || ' ' || n_chars", "constraint": "lang || ' ' || split_part(text, chr(10), 1)", "primary": "upper(lang) || ':' || split_part(text, chr(10), 1)"}


@query("SELECT doc_id, " + ", ".join(f"md5({v}) AS {k}" for k, v in _VIEWS.items()) + " FROM documents")
def text_views(spark, d):
    """PRJ-03/04: seven views of one record, each of its own columns."""
    t, title = F.col("text"), T.first_line(F.col("text"))
    views = {"title": title, "rest": F.expr("substring(text, length(split(text, '\\n', 2)[0]) + 2)"), "identity": F.concat_ws(" ", "lang", "source"), "searchable": F.concat_ws(" ", t, "source"), "structured": F.concat_ws(" ", "source", F.col("n_chars").cast("string")), "constraint": F.concat_ws(" ", F.col("lang"), title), "primary": F.concat(F.upper("lang"), F.lit(":"), title)}
    return table(spark, d, "documents").select("doc_id", *[F.md5(v.cast("binary")).alias(k) for k, v in views.items()])


@query("""WITH s AS (SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS c, text FROM conversations), r AS (SELECT conv_id, turn, replace(replace(c, 'ation', 'tion'), 'chch', 'ch') AS t, text FROM s WHERE c <> '')
SELECT conv_id, turn, md5(t) AS text_md5, CASE WHEN t <> text THEN md5(text) END AS raw_md5, round(CAST(turn * 1.234 AS DOUBLE), 2) AS start FROM r""")
def runtime_segments(spark, d):
    """PRJ-07: spaces collapsed, known mishearings put right, empty ones dropped, times rounded; the raw text only where it changed."""
    c = table(spark, d, "conversations").withColumn("c", F.trim(F.regexp_replace("text", r"\s+", " "))).where("c <> ''").withColumn("t", T.replace_longest_first(F.col("c"), {"ation": "tion", "chch": "ch"}))
    return c.select("conv_id", "turn", F.md5(F.col("t").cast("binary")).alias("text_md5"), F.when(F.col("t") != F.col("text"), F.md5(F.col("text").cast("binary"))).alias("raw_md5"), F.round(F.col("turn") * 1.234, 2).alias("start"))


@query("""WITH r AS (SELECT lang || '/' || source AS topic, doc_id, n_chars, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id) AS k, count(*) OVER (PARTITION BY lang, source) AS n FROM documents)
SELECT topic, any_value(n) AS n, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY k) AS reps FROM r WHERE k <= 3 GROUP BY topic""")
def topic_map(spark, d):
    """PRJ-08, MSC-05: categories and their parts flattened to one id, each with its three first representatives."""
    x = table(spark, d, "documents").select(F.concat_ws("/", "lang", "source").alias("topic"), "doc_id", "n_chars")
    n = x.groupBy("topic").agg(F.count("*").alias("n"))
    top = x.withColumn("k", F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("n_chars"), "doc_id"))).where("k <= 3")
    reps = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "doc_id"))), lambda s: s["doc_id"].cast("string")), ",")
    return top.groupBy("topic").agg(reps.alias("reps")).join(n, "topic").select("topic", "n", "reps")


@query("""SELECT 'local' AS layer, 'c' || conv_id AS id, CAST(turn AS INTEGER) AS position, role AS kind, md5(text) AS body FROM conversations UNION ALL SELECT 'global', 'd' || doc_id, 0, CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END, md5(text) FROM documents JOIN labels USING (doc_id)""")
def feedback_records(spark, d):
    """PRJ-09, FB-06: two shapes of record in one."""
    c = table(spark, d, "conversations").select(F.lit("local").alias("layer"), F.concat(F.lit("c"), "conv_id").alias("id"), F.col("turn").cast("int").alias("position"), F.col("role").alias("kind"), F.md5(F.col("text").cast("binary")).alias("body"))
    g = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select(F.lit("global"), F.concat(F.lit("d"), "doc_id"), F.lit(0), F.when(F.col("quality") == 1, "good").otherwise("bad"), F.md5(F.col("text").cast("binary")))
    return c.union(g)


@query("""WITH r AS (SELECT conv_id, turn, unnest([CASE WHEN turn = 0 THEN 'opening' END, CASE WHEN role = 'assistant' THEN 'reply' END, CASE WHEN length(text) > 200 THEN 'long' END, CASE WHEN contains(text, 'the ') THEN 'english' END]) AS role FROM conversations)
SELECT conv_id, turn, string_agg(role, '+' ORDER BY role) AS roles FROM r WHERE role IS NOT NULL GROUP BY 1, 2""")
def evidence_roles(spark, d):
    """PRJ-06: several arrays of evidence as rows, then one row a place with all its roles."""
    parts = {"opening": F.col("turn") == 0, "reply": F.col("role") == "assistant", "long": F.length("text") > 200, "english": F.contains("text", F.lit("the "))}
    r = table(spark, d, "conversations").select("conv_id", "turn", F.explode(F.array_compact(F.array(*[F.when(c, k) for k, c in parts.items()]))).alias("role"))
    return r.groupBy("conv_id", "turn").agg(F.array_join(F.array_sort(F.collect_set("role")), "+").alias("roles"))


# filters and validators


@query("""WITH c AS (SELECT regexp_extract(url, '^[a-z]+://([^/:]+)', 1) AS host, page_id, url, CASE WHEN contains(url, '?') THEN 2 WHEN contains(url, '#') THEN 1 ELSE 0 END AS kind FROM pages), u AS (SELECT host, url, min(kind) AS kind, min(page_id) AS page_id FROM c WHERE starts_with(url, 'https://') AND length(url) < 120 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY kind, page_id) AS k, count(*) OVER (PARTITION BY host) AS candidates FROM u) SELECT host, page_id, url, candidates FROM r WHERE k = 1""")
def asset_choice(spark, d):
    """FLT-07: of a host's addresses, each once and only those that pass the policy, the first by kind, then by id."""
    p = table(spark, d, "pages").where(F.startswith("url", F.lit("https://")) & (F.length("url") < 120))
    kind = F.when(F.contains("url", F.lit("?")), 2).when(F.contains("url", F.lit("#")), 1).otherwise(0)
    u = p.groupBy(F.regexp_extract("url", r"^[a-z]+://([^/:]+)", 1).alias("host"), "url").agg(F.min(kind).alias("kind"), F.min("page_id").alias("page_id"))
    return X.first_by(u, ["host"], ["kind", "page_id"]).select("host", "page_id", "url", "candidates")


@query("""SELECT page_id, CASE WHEN length(html) < 1500 THEN 'too_small' WHEN starts_with(html, '<!DOCTYPE html>') THEN 'ok' WHEN starts_with(html, '<html') THEN 'no_doctype' ELSE 'not_html' END AS error FROM pages""")
def magic_bytes(spark, d):
    """FLT-09: the size and the first bytes of a payload."""
    return table(spark, d, "pages").select("page_id", X.signature(F.col("html").cast("binary"), F.length("html"), 1500, {"ok": b"<!DOCTYPE html>", "no_doctype": b"<html"}, "too_small", "not_html").alias("error"))


@query("""WITH s AS (SELECT user_id, ts, value, event_id, lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events)
SELECT user_id, count(*) AS segments, count(*) FILTER (WHERE ts < before) AS not_monotone, count(*) FILTER (WHERE value < 0 OR value IS NULL) AS not_finite, count(*) FILTER (WHERE value > 60) AS improbable, date_diff('second', min(ts), max(ts)) > 2500000 AS too_long, count(*) FILTER (WHERE ts < before) = 0 AND count(*) FILTER (WHERE value > 60) = 0 AS valid FROM s GROUP BY 1""")
def transcript_check(spark, d):
    """FLT-11: a stream of segments: order, bounds, length."""
    s = table(spark, d, "events").withColumn("before", F.lag("ts").over(Window.partitionBy("user_id").orderBy("event_id")))
    late, high = F.count_if(F.col("ts") < F.col("before")), F.count_if(F.col("value") > 60)
    span = F.expr("timestampdiff(SECOND, min(ts), max(ts))")
    return s.groupBy("user_id").agg(F.count("*").alias("segments"), late.alias("not_monotone"), F.count_if((F.col("value") < 0) | F.col("value").isNull()).alias("not_finite"), high.alias("improbable"), (span > 2500000).alias("too_long"), ((late == 0) & (high == 0)).alias("valid"))


@query("""WITH k AS (SELECT user_id, count(*) AS known FROM events WHERE ts < TIMESTAMP '2024-01-15 00:00:00' GROUP BY 1), n AS (SELECT user_id, count(*) AS seen, max(ts) AS last FROM events WHERE ts >= TIMESTAMP '2024-01-15 00:00:00' GROUP BY 1), x AS (SELECT user_id, known, coalesce(seen, 0) AS seen, last, greatest(20, CAST(floor(known * 0.9 + 0.999) AS BIGINT)) AS least FROM k LEFT JOIN n USING (user_id))
SELECT user_id, known, seen, least, CASE WHEN last IS NULL THEN 'empty' WHEN date_diff('second', last, TIMESTAMP '2024-01-31 00:00:00') > 86400 THEN 'stale' WHEN seen < least THEN 'too_few' ELSE 'ok' END AS verdict FROM x""")
def snapshot_check(spark, d):
    """FLT-12: a snapshot's freshness, and how many of the known rows it must cover."""
    e = table(spark, d, "events")
    cut, now = F.to_timestamp_ntz(F.lit("2024-01-15 00:00:00")), F.to_timestamp_ntz(F.lit("2024-01-31 00:00:00"))
    k = e.where(F.col("ts") < cut).groupBy("user_id").agg(F.count("*").alias("known"))
    n = e.where(F.col("ts") >= cut).groupBy("user_id").agg(F.count("*").alias("seen"), F.max("ts").alias("last"))
    x = k.join(n, "user_id", "left").withColumn("seen", F.coalesce("seen", F.lit(0))).withColumn("least", X.least_coverage(F.col("known"), 20, 0.9))
    age = F.timestamp_diff("SECOND", F.col("last"), now)
    return x.select("user_id", "known", "seen", "least", F.when(F.col("last").isNull(), "empty").when(age > 86400, "stale").when(F.col("seen") < F.col("least"), "too_few").otherwise("ok").alias("verdict"))


@query("""SELECT 'orders_without_customer' AS rule, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'lines_without_order', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'orders_without_lines', count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT 'unlabelled_documents', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'negative_balance', count(*) FROM customer WHERE c_acctbal < 0
UNION ALL SELECT 'customers_without_orders', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'large_discount', count(*) FROM lineitem WHERE l_discount > 0.09""")
def project_assertions(spark, d):
    """FLT-14: a suite of checks over all tables, one row a rule with its violations."""
    t = lambda n: table(spark, d, n)
    gone = lambda a, x, b, y: t(a).join(t(b).select(F.col(y).alias(x)), x, "left_anti")
    rules = {
        "orders_without_customer": gone("orders", "o_custkey", "customer", "c_custkey"), "lines_without_order": gone("lineitem", "l_orderkey", "orders", "o_orderkey"), "orders_without_lines": gone("orders", "o_orderkey", "lineitem", "l_orderkey"),
        "unlabelled_documents": gone("documents", "doc_id", "labels", "doc_id"), "negative_balance": t("customer").where("c_acctbal < 0"), "customers_without_orders": gone("customer", "c_custkey", "orders", "o_custkey"), "large_discount": t("lineitem").where("l_discount > 0.09"),
    }
    return X.suite(rules)


@query("""WITH w AS (SELECT page_id, list_distinct(regexp_extract_all(url, '([0-9]+)', 1)) AS ids FROM pages), r AS (SELECT list(CAST(doc_id AS VARCHAR)) AS ready FROM labels WHERE quality = 1)
SELECT page_id, len(list_filter(ids, lambda x: NOT list_contains(ready, x))) > 0 AS blocking, CAST(len(ids) AS INTEGER) AS n FROM w, r WHERE len(ids) > 0""")
def blocking_warnings(spark, d):
    """FLT-15: a warning blocks until all ids that it names are ready."""
    ids = F.array_distinct(F.regexp_extract_all("url", F.lit("([0-9]+)"), F.lit(1)))
    w = table(spark, d, "pages").select("page_id", ids.alias("ids")).where(F.size("ids") > 0)
    ready = table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").cast("string").alias("id"), F.lit(1).alias("ready")).distinct()
    x = w.select("page_id", F.size("ids").alias("n"), F.explode("ids").alias("id")).join(ready, "id", "left")
    return x.groupBy("page_id").agg(F.bool_or(F.col("ready").isNull()).alias("blocking"), F.first("n").alias("n"))


# aggregates, windows, orders, sets


@query("""SELECT l_orderkey, bool_and(l_quantity > 5) AS every_large, bool_or(l_returnflag = 'R') AS some_back, bool_and(l_shipdate IS NOT NULL) AS complete, count(*) FILTER (WHERE l_tax > 0.05) = 0 AS none_taxed FROM lineitem GROUP BY 1""")
def all_any(spark, d):
    """AGG-18."""
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.bool_and(F.col("l_quantity") > 5).alias("every_large"), F.bool_or(F.col("l_returnflag") == "R").alias("some_back"), F.bool_and(F.col("l_shipdate").isNotNull()).alias("complete"), (F.count_if(F.col("l_tax") > 0.05) == 0).alias("none_taxed"))


_ITEMS = {"greeting": ["the ", "der "], "reason": ["that ", "que "], "place": ["in ", "en "], "close": ["was ", "war "]}


@query("WITH i AS (" + " UNION ALL ".join(f"SELECT conv_id, '{k}' AS item, bool_or({' OR '.join(f'contains(lower(text), {chr(39)}{t}{chr(39)})' for t in ts)}) AS covered FROM conversations GROUP BY 1" for k, ts in _ITEMS.items()) + ") SELECT item, count(*) AS conversations, count(*) FILTER (WHERE covered) AS covered, round(count(*) FILTER (WHERE covered) / count(*), 4) AS share FROM i GROUP BY 1")
def completeness(spark, d):
    """AGG-19: of every item of a checklist, whether each conversation covers it, and how many do."""
    t = F.lower("text")
    each = F.array(*[F.struct(F.lit(k).alias("item"), _has(t, ts).alias("c")) for k, ts in _ITEMS.items()])
    i = table(spark, d, "conversations").select("conv_id", F.explode(each).alias("x")).groupBy("conv_id", "x.item").agg(F.bool_or("x.c").alias("covered"))
    return i.groupBy("item").agg(F.count("*").alias("conversations"), F.count_if("covered").alias("covered"), F.round(F.count_if("covered") / F.count("*"), 4).alias("share"))


_PRIO = "CASE source WHEN 'src0' THEN 20 WHEN 'src1' THEN 12 ELSE 5 END + least(4 * (length(text) - length(replace(text, chr(10), ''))), 16) + least(6 * CAST(contains(text, '@') AS INTEGER) + 6 * CAST(contains(text, ' | ') AS INTEGER), 18) + CASE WHEN n_chars > 5000 THEN 10 WHEN n_chars > 2000 THEN 4 ELSE 0 END + least(len(regexp_extract_all(text, '[.]')), 8)"


@query(f"SELECT doc_id, CAST({_PRIO} AS INTEGER) AS priority FROM documents")
def review_priority(spark, d):
    """AGG-20: weights of the category, of what was found (each kind up to a limit), and bonuses by length."""
    t = F.col("text")
    lines = F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))
    kinds = 6 * F.contains(t, F.lit("@")).cast("int") + 6 * F.contains(t, F.lit(" | ")).cast("int")
    p = F.when(F.col("source") == "src0", 20).when(F.col("source") == "src1", 12).otherwise(5) + F.least(4 * lines, F.lit(16)) + F.least(kinds, F.lit(18)) + F.when(F.col("n_chars") > 5000, 10).when(F.col("n_chars") > 2000, 4).otherwise(0) + F.least(F.regexp_count(t, F.lit("[.]")), F.lit(8))
    return table(spark, d, "documents").select("doc_id", p.cast("int").alias("priority"))


@query("WITH r AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS k FROM conversations WHERE role = 'assistant') SELECT conv_id, turn, 'V' || k AS label FROM r")
def dense_labels(spark, d):
    """WIN-05: V1 to Vn in the final order."""
    a = table(spark, d, "conversations").where("role = 'assistant'")
    return a.select("conv_id", "turn", F.concat(F.lit("V"), F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc(F.length("text")), "turn"))).alias("label"))


@query("WITH x AS (SELECT lang, d.doc_id, n_chars, coalesce(quality, 0) = 1 AS eligible FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY eligible DESC, n_chars DESC, doc_id) AS place FROM x) SELECT lang, doc_id, eligible, CAST(place AS INTEGER) AS place FROM r WHERE place <= 20")
def eligible_first(spark, d):
    """SRT-02: what is eligible comes first, each part in its own order; the report's first twenty."""
    x = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").withColumn("eligible", F.coalesce("quality", F.lit(0)) == 1)
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("eligible"), F.desc("n_chars"), "doc_id"))
    return x.withColumn("place", place).where("place <= 20").select("lang", "doc_id", "eligible", "place")


_NAV = Rules("nav", "topic string, name string, keyword string, sport string", [("grip", "tion", "able", "a"), ("step", "ther", "ing", "a"), ("serve", "lich", "ung", "b"), ("smash", "ment", "eau", "a"), ("drop", "cion", "ado", "b")])


@query(f"""WITH {_NAV.sql}, q AS (SELECT item_id, lower(text) AS t FROM benchmark), s AS (SELECT item_id, topic, 18 * CAST(contains(t, name) AS INTEGER) + 14 * CAST(contains(t, keyword) AS INTEGER) + 8 * CAST(contains(t, topic) AS INTEGER) AS score FROM q, nav WHERE NOT (sport = 'b' AND contains(t, 'the '))),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, topic) AS k FROM s WHERE score > 0) SELECT item_id, topic, CAST(score AS INTEGER) AS score, CAST(k AS INTEGER) AS place FROM r WHERE k <= 2""")
def topic_navigation(spark, d):
    """SRT-08: topics by name, keyword and id; other disciplines are left out; the two best."""
    q = table(spark, d, "benchmark").select("item_id", F.lower("text").alias("t")).join(F.broadcast(_NAV.df(spark)), ~((F.col("sport") == "b") & F.contains("t", F.lit("the "))))
    hit = lambda c: F.contains("t", F.col(c)).cast("int")
    s = q.select("item_id", "topic", (18 * hit("name") + 14 * hit("keyword") + 8 * hit("topic")).alias("score")).where("score > 0")
    return s.withColumn("place", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "topic"))).where("place <= 2")


@query("WITH n AS (SELECT o_custkey, o_orderkey, 0 AS part FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT o_custkey, o_orderkey, 1 FROM orders WHERE o_orderstatus <> 'O') SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY part, o_orderkey DESC) AS INTEGER) AS position FROM n")
def newest_first(spark, d):
    """SET-02: new rows stand before old ones in an append-only list."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderstatus") != "O").cast("int").alias("part"))
    return o.select("o_custkey", "o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy("part", F.desc("o_orderkey"))).alias("position"))


# functions


@query("SELECT doc_id, CAST(len(regexp_extract_all(lower(text), 'there|ther|the|tion')) AS INTEGER) AS n_terms, CAST(length(regexp_replace(regexp_replace(text, 'https?://[^ \\n]+', '', 'g'), '\\s', '', 'g')) AS INTEGER) AS n_solid, contains(lower(text), 'that the') AS covered FROM documents")
def term_pattern(spark, d):
    """FN-10/26: occurrences of an alternation, longest terms first; the length without addresses and spaces; whether a point is covered."""
    solid = F.length(F.regexp_replace(F.regexp_replace("text", r"https?://[^ \n]+", ""), r"\s", ""))
    return table(spark, d, "documents").select("doc_id", F.regexp_count(F.lower("text"), F.lit(X.alternation(["the", "there", "tion", "ther"]))).alias("n_terms"), solid.alias("n_solid"), F.contains(F.lower("text"), F.lit("that the")).alias("covered"))


_STOPPED = "regexp_replace(regexp_replace(lower(text), 'that|with|the', '', 'g'), '[^a-z]', '', 'g')"


@query(f"WITH t AS (SELECT doc_id, {_STOPPED} AS t FROM documents), g AS (SELECT doc_id, list_sort(list_distinct(list_transform(range(1, length(t)), lambda i: substr(t, i, 2)))) AS g FROM t) SELECT doc_id, CAST(len(g) AS INTEGER) AS n, md5(array_to_string(g, ',')) AS grams FROM g")
def content_grams(spark, d):
    """FN-27: 2-grams without stop phrases."""
    g = T.grams(F.regexp_replace(F.regexp_replace(F.lower("text"), X.alternation(["the", "that", "with"]), ""), "[^a-z]", ""), 2)
    return table(spark, d, "documents").select("doc_id", g.alias("g")).select("doc_id", F.size("g").alias("n"), F.md5(F.array_join("g", ",").cast("binary")).alias("grams"))


@query("""WITH n AS (SELECT conv_id, turn, list_filter(string_split(text, chr(10)), lambda l: trim(l) <> '' AND NOT contains(l, '@')) AS lines, lower(text) AS t FROM conversations)
SELECT conv_id, turn, CAST(len(lines) AS INTEGER) AS n_lines, CASE WHEN contains(t, 'nicht') THEN 'rejected' WHEN contains(t, 'with') OR contains(t, 'mit') THEN 'accepted' ELSE 'pending' END AS status, CASE WHEN contains(t, ' this ') THEN 'video' WHEN contains(t, 'der ') THEN 'transcript' ELSE 'unknown' END AS evidence FROM n""")
def review_notes(spark, d):
    """FN-30: the lines of a note that say something, its status and where the evidence is from."""
    t = F.lower("text")
    lines = F.filter(F.split("text", "\n"), lambda x: (F.trim(x) != "") & ~F.contains(x, F.lit("@")))
    return table(spark, d, "conversations").select("conv_id", "turn", F.size(lines).alias("n_lines"), F.when(_has(t, ["nicht"]), "rejected").when(_has(t, ["with", "mit"]), "accepted").otherwise("pending").alias("status"), F.when(_has(t, [" this "]), "video").when(_has(t, ["der "]), "transcript").otherwise("unknown").alias("evidence"))


_LEVEL = {"high": 3, "medium": 2, "low": 1}


@query("""WITH x AS (SELECT conv_id, CASE WHEN length(text) > 400 THEN 3 WHEN length(text) > 100 THEN 2 ELSE 1 END AS l, role = 'assistant' AS direct FROM conversations)
SELECT conv_id, ['low', 'medium', 'high'][min(l)] AS ceiling, ['low', 'medium', 'high'][max(l)] AS best, CASE WHEN bool_and(direct) THEN 'direct' WHEN bool_or(direct) THEN 'mixed' ELSE 'indirect' END AS directness FROM x GROUP BY 1""")
def confidence_ceiling(spark, d):
    """FN-33: ordinals of confidence, the least of which is the ceiling, and how direct the evidence is."""
    level = F.when(F.length("text") > 400, "high").when(F.length("text") > 100, "medium").otherwise("low")
    x = table(spark, d, "conversations").select("conv_id", X.ordinal(level, _LEVEL).alias("l"), (F.col("role") == "assistant").alias("direct"))
    name = F.create_map(*[v for k, o in _LEVEL.items() for v in (F.lit(o), F.lit(k))])
    g = x.groupBy("conv_id").agg(F.min("l").alias("a"), F.max("l").alias("b"), F.bool_and("direct").alias("every"), F.bool_or("direct").alias("some"))
    return g.select("conv_id", name[F.col("a")].alias("ceiling"), name[F.col("b")].alias("best"), F.when(F.col("every"), "direct").when(F.col("some"), "mixed").otherwise("indirect").alias("directness"))


@query("SELECT page_id, CASE WHEN regexp_matches(lower(url), '(en|de)/[0-9]+') THEN 'video' WHEN regexp_matches(lower(url), '[?#]') THEN 'audio' ELSE 'other' END AS kind, trim(regexp_replace(lower(regexp_replace(url, '^https?://', '')), '[^a-z0-9]+', '-', 'g'), '-') AS slug, replace(replace(url, '\"', '#quot;'), '&', '#amp;') AS label FROM pages")
def asset_kind(spark, d):
    """FN-25/34: the kind of an asset by its address; a slug and an escaped label."""
    u = F.lower("url")
    slug = F.btrim(F.regexp_replace(F.lower(F.regexp_replace("url", "^https?://", "")), "[^a-z0-9]+", "-"), F.lit("-"))
    return table(spark, d, "pages").select("page_id", F.when(u.rlike("(en|de)/[0-9]+"), "video").when(u.rlike("[?#]"), "audio").otherwise("other").alias("kind"), slug.alias("slug"), X.diagram_label(F.col("url")).alias("label"))


@query("""WITH q AS (SELECT item_id, lower(text) AS t, list_distinct(regexp_extract_all(lower(text), '([a-z]{5,})', 1)) AS w FROM benchmark) SELECT item_id, CAST(CASE WHEN contains(t, 'that the') THEN 50 ELSE 0 END + 10 * len(list_filter(w, lambda x: contains(x, 'ther'))) + 2 * len(list_filter(w, lambda x: contains(x, 'ing'))) AS INTEGER) AS score FROM q""")
def text_score(spark, d):
    """FN-28: points for a phrase, for words that hold a term, for words that hold a part of one."""
    w = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{5,})"), F.lit(1)))
    n = lambda x: F.size(F.filter(w, lambda v: F.contains(v, F.lit(x))))
    return table(spark, d, "benchmark").select("item_id", (F.when(_has(F.lower("text"), ["that the"]), 50).otherwise(0) + 10 * n("ther") + 2 * n("ing")).alias("score"))


# stores, queues and states


@query("""WITH e AS (SELECT conv_id, turn, role, text, sha256(conv_id || ':' || turn || ':' || text) AS digest FROM conversations), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k, count(*) OVER (PARTITION BY conv_id) AS n, string_agg(digest, '' ) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS all_d FROM e)
SELECT 'F-' || substr(sha256(CAST(conv_id AS VARCHAR)), 1, 12) AS id, n AS entries, CASE WHEN role = 'assistant' THEN 'reviewed' ELSE 'pending' END AS status, sha256(all_d) AS integrity FROM r WHERE k = 1""")
def feedback_store(spark, d):
    """FB-02: an append-only store: one record an id, its last status, and a digest over all its entries."""
    e = table(spark, d, "conversations").withColumn("digest", F.sha2(F.concat_ws(":", "conv_id", "turn", "text").cast("binary"), 256))
    g = e.groupBy("conv_id").agg(F.count("*").alias("entries"), F.max_by("role", "turn").alias("role"), F.array_sort(F.collect_list(F.struct("turn", "digest"))).alias("ds"))
    chain = F.array_join(F.transform("ds", lambda s: s["digest"]), "")
    return g.select(T.short_id("F-", F.col("conv_id").cast("string"), 12).alias("id"), "entries", F.when(F.col("role") == "assistant", "reviewed").otherwise("pending").alias("status"), F.sha2(chain.cast("binary"), 256).alias("integrity"))


@query("""WITH x AS (SELECT user_id, event_id, ts, md5(event_type || CAST(CAST(floor(value / 20) AS BIGINT) AS VARCHAR)) AS h FROM events), y AS (SELECT *, lag(h) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM x), z AS (SELECT * FROM y WHERE b IS NULL OR b <> h),
r AS (SELECT user_id, event_id, h, row_number() OVER w AS revision, lead(event_id) OVER w AS superseded_by FROM z WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT user_id, event_id, h AS body_hash, CAST(revision AS INTEGER) AS revision, superseded_by, CASE WHEN superseded_by IS NULL THEN 'current' ELSE 'superseded' END AS status FROM r""")
def import_revisions(spark, d):
    """FB-03, WIN-12: a source's imports: an equal body changes nothing, another one is the next revision and supersedes the last."""
    e = table(spark, d, "events").withColumn("body_hash", F.md5(F.concat("event_type", F.floor(F.col("value") / 20).cast("string")).cast("binary")))
    return X.revision_chain(e, ["user_id"], ["ts", "event_id"], "body_hash", "event_id")


@query("""WITH l AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k, count(*) OVER (PARTITION BY user_id) AS revision FROM events), p AS (SELECT user_id, max(event_id) AS published FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT l.user_id, CASE WHEN event_type <> 'signup' AND event_type <> 'purchase' THEN 'rejected' WHEN published = event_id THEN 'unchanged' WHEN published IS NULL THEN 'published' ELSE 'republished' END AS outcome, CASE WHEN event_type IN ('signup', 'purchase') THEN 'S-' || substr(sha256(l.user_id || ':' || revision), 1, 12) END AS signal_id FROM l LEFT JOIN p ON p.user_id = l.user_id WHERE k = 1""")
def promotions(spark, d):
    """FB-04: only what was accepted last is published; the same revision again changes nothing."""
    e = table(spark, d, "events")
    last = e.groupBy("user_id").agg(F.max_by(F.struct("event_type", "event_id"), F.struct("ts", "event_id")).alias("l"), F.count("*").alias("revision"))
    p = e.where("event_type = 'purchase'").groupBy("user_id").agg(F.max("event_id").alias("published"))
    j = last.join(p, "user_id", "left")
    ok = F.col("l.event_type").isin("signup", "purchase")
    outcome = F.when(~ok, "rejected").when(F.col("published") == F.col("l.event_id"), "unchanged").when(F.col("published").isNull(), "published").otherwise("republished")
    return j.select("user_id", outcome.alias("outcome"), F.when(ok, T.short_id("S-", F.concat_ws(":", "user_id", "revision"), 12)).alias("signal_id"))


@query("""WITH s AS (SELECT doc_id, 'review_pending' AS status FROM documents WHERE n_chars < 1500), r AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'kept' ELSE 'excluded' END AS resolution FROM labels), x AS (SELECT s.doc_id, status, resolution FROM s LEFT JOIN r USING (doc_id))
SELECT coalesce(resolution, status) AS status, count(*) AS n, count(*) FILTER (WHERE resolution IS NOT NULL) AS moved, CAST(sum(CASE WHEN resolution IS NULL THEN 0 ELSE -1 END) AS BIGINT) AS pending_delta FROM x GROUP BY 1""")
def review_resolution(spark, d):
    """ST-03: pending reviews become kept or excluded, and only those; what the counters change by."""
    s = table(spark, d, "documents").where("n_chars < 1500").select("doc_id", F.lit("review_pending").alias("status"))
    r = table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "kept").otherwise("excluded").alias("resolution"))
    x = X.transition(s, r, "doc_id", {"review_pending": ["kept", "excluded"]})
    return x.groupBy("status").agg(F.count("*").alias("n"), F.count_if("moved").alias("moved"), F.sum(F.when(F.col("moved"), -1).otherwise(0)).alias("pending_delta"))


@query("""WITH src AS (SELECT doc_id, n_chars FROM documents WHERE doc_id % 4 <> 3), prev AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'transcribed' WHEN doc_id % 3 = 1 THEN 'failed' ELSE 'ready' END AS status, doc_id % 5 AS attempts FROM documents WHERE doc_id % 2 = 1), t AS (SELECT DISTINCT doc_id, true AS has FROM labels)
SELECT coalesce(src.doc_id, prev.doc_id) AS doc_id, CASE WHEN has AND src.doc_id IS NOT NULL THEN 'transcribed' ELSE coalesce(prev.status, 'ready') END AS status, coalesce(attempts, 0) AS attempts, src.doc_id IS NULL AS orphan FROM src FULL JOIN prev ON src.doc_id = prev.doc_id LEFT JOIN t ON t.doc_id = coalesce(src.doc_id, prev.doc_id) WHERE src.doc_id IS NOT NULL OR prev.status IN ('transcribed', 'failed')""")
def queue_bootstrap(spark, d):
    """ST-04: a queue from its source and its last state; finished rows that the source dropped stay."""
    x = table(spark, d, "documents")
    prev = x.where("doc_id % 2 = 1").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "transcribed").when(F.col("doc_id") % 3 == 1, "failed").otherwise("ready").alias("status"), (F.col("doc_id") % 5).alias("attempts"))
    return X.queue(x.where("doc_id % 4 <> 3").select("doc_id"), prev, table(spark, d, "labels").select("doc_id").distinct(), "doc_id", ["transcribed", "failed"])


@query("""WITH q AS (SELECT user_id, event_id, event_type, props, value FROM events) SELECT event_id, event_type, CASE WHEN event_type IN ('purchase', 'error') THEN NULL ELSE md5(props) END AS temp_path, CASE WHEN event_type = 'purchase' THEN NULL ELSE value END AS temp_value, event_type IN ('purchase', 'error') AS terminal FROM q""")
def media_state(spark, d):
    """ST-05: temporary fields are null once a row is finished."""
    done = F.col("event_type").isin("purchase", "error")
    return table(spark, d, "events").select("event_id", "event_type", F.when(~done, F.md5(F.col("props").cast("binary"))).alias("temp_path"), F.when(F.col("event_type") != "purchase", F.col("value")).alias("temp_value"), done.alias("terminal"))


@query("""WITH o AS (SELECT doc_id, length(text) AS n, n_chars FROM documents WHERE doc_id % 3 <> 0) SELECT CASE WHEN o.doc_id IS NULL THEN 'todo' WHEN n < 300 THEN 'redo' ELSE 'skip' END AS action, count(*) AS docs, CAST(sum(d.n_chars) AS BIGINT) AS chars FROM documents d LEFT JOIN o ON o.doc_id = d.doc_id GROUP BY 1""")
def resume_plan(spark, d):
    """ST-07: outputs that are there and valid are skipped, invalid ones done again."""
    x = table(spark, d, "documents")
    o = x.where("doc_id % 3 <> 0").select("doc_id", F.length("text").alias("n"))
    a = F.when(F.col("n").isNull(), "todo").when(F.col("n") < 300, "redo").otherwise("skip")
    return x.join(o, "doc_id", "left").groupBy(a.alias("action")).agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"))


@query("""WITH q AS (SELECT doc_id, source, source AS old_tags, CASE WHEN doc_id % 4 = 0 THEN '' ELSE lang END AS new_tags FROM documents) SELECT doc_id, coalesce(nullif(new_tags, ''), old_tags) AS tags, new_tags = '' AS kept_old FROM q""")
def enrichment_update(spark, d):
    """JON-22: a ledger's columns overwrite the queue's; the old value stays where the new one is empty."""
    x = table(spark, d, "documents")
    ledger = x.select("doc_id", F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.col("lang")).alias("tags"))
    return X.enrich(x.select("doc_id", F.col("source").alias("tags")), ledger, "doc_id", "tags")


# reports


@query("""WITH s AS (SELECT lang, source, count(*) AS n, count(*) FILTER (WHERE n_chars < 200) AS failed FROM documents GROUP BY 1, 2) SELECT lang, CAST(sum(n) AS BIGINT) AS n, CAST(sum(failed) AS BIGINT) AS failed, string_agg(source, ',' ORDER BY source) FILTER (WHERE failed > 0) AS sources FROM s GROUP BY 1""")
def failure_report(spark, d):
    """GV-07: what failed, beside the status counts."""
    s = table(spark, d, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"), F.count_if(F.col("n_chars") < 200).alias("failed"))
    names = F.array_sort(F.collect_list(F.when(F.col("failed") > 0, F.col("source"))))
    return s.groupBy("lang").agg(F.sum("n").alias("n"), F.sum("failed").alias("failed"), F.when(F.size(names) > 0, F.array_join(names, ",")).alias("sources"))


@query(f"""SELECT source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars, substr({T.set_digest_sql("concat_ws(':', doc_id, md5(text))")}, 1, 16) AS build FROM documents GROUP BY source""")
def manifest(spark, d):
    """GV-02, MSC-06: counts and hashes of each part, and the build's id."""
    row = F.concat_ws(":", "doc_id", F.md5(F.col("text").cast("binary")))
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.substring(T.set_digest(row), 1, 16).alias("build"))


@query("""WITH e AS (SELECT DISTINCT 'root' AS a, lang AS b FROM documents UNION SELECT DISTINCT lang, lang || '/' || source FROM documents UNION SELECT DISTINCT lang || '/' || source, 'd' || doc_id FROM documents WHERE n_chars > 5000)
SELECT count(*) AS edges, sha256(string_agg('  "' || a || '" --> "' || b || '"', chr(10) ORDER BY a, b)) AS diagram FROM e WHERE a <> b""".replace("sha256(string_agg('  \"' || a || '\" --> \"' || b || '\"', chr(10) ORDER BY a, b))", "CAST(bit_xor(CAST(('0x' || substr(md5('  \"' || a || '\" --> \"' || b || '\"'), 1, 12)) AS BIGINT)) AS BIGINT)"))
def graph_lines(spark, d):
    """SNK-07: root, categories, parts and items as lines of a diagram; a digest that doesn't depend on their order."""
    x = table(spark, d, "documents")
    part = F.concat_ws("/", "lang", "source")
    e = x.select(F.lit("root").alias("a"), F.col("lang").alias("b")).union(x.select("lang", part)).union(x.where("n_chars > 5000").select(part, F.concat(F.lit("d"), "doc_id"))).distinct()
    line = X.diagram_edge(F.col("a"), F.col("b"))
    h = F.conv(F.substring(F.md5(line.cast("binary")), 1, 12), 16, 10).cast("long")
    return e.agg(F.count("*").alias("edges"), F.bit_xor(h).alias("diagram"))


@query("""WITH a AS (SELECT doc_id, md5(text) AS h FROM documents), b AS (SELECT doc_id, md5(CASE WHEN doc_id % 40 = 0 THEN text || ' ' ELSE text END) AS h FROM documents WHERE doc_id % 41 <> 0 UNION ALL SELECT -1 - doc_id, md5(text) FROM documents WHERE doc_id % 100 = 0)
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'only_copy' WHEN b.doc_id IS NULL THEN 'only_source' ELSE 'differs' END AS mismatch FROM a FULL JOIN b ON a.doc_id = b.doc_id WHERE a.h IS NULL OR b.h IS NULL OR a.h <> b.h""")
def reference_mismatches(spark, d):
    """SNK-11: a source against its copy, byte for byte."""
    x = table(spark, d, "documents").select("doc_id", "text")
    copy = x.where("doc_id % 41 <> 0").select("doc_id", F.when(F.col("doc_id") % 40 == 0, F.concat("text", F.lit(" "))).otherwise(F.col("text")).alias("text")).union(x.where("doc_id % 100 = 0").select(-1 - F.col("doc_id"), "text"))
    return X.mismatches(x, copy, "doc_id", "text")


@query("""SELECT conv_id, turn, CASE WHEN len(regexp_extract_all(text, '[Tt]he ')) = 1 THEN md5(regexp_replace(text, '[Tt]he ', 'A ')) END AS replaced_md5, CAST(len(regexp_extract_all(text, '[Tt]he ')) AS INTEGER) AS n FROM conversations""")
def replace_exactly_once(spark, d):
    """GV-06, SNK-10: a substitution that only counts where the pattern is there exactly once."""
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(X.replace_one(F.col("text"), "[Tt]he ", "A ").cast("binary")).alias("replaced_md5"), F.regexp_count("text", F.lit("[Tt]he ")).alias("n"))


@query("""SELECT l.doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'regression_ready' WHEN quality = 1 THEN 'needs_check' ELSE 'draft' END AS state, CASE toxic WHEN 1 THEN 'excluded' ELSE CASE quality WHEN 1 THEN 'kept' ELSE 'review_pending' END END AS ledger, quality = 1 OR n_chars > 4000 AS teaching FROM labels l JOIN documents d ON d.doc_id = l.doc_id""")
def case_states(spark, d):
    """MSC-01/09/11: ledger status of a decision, whether a case can be held against, whether there is evidence to teach from."""
    x = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id")
    q, t = F.col("quality") == 1, F.col("toxic") == 1
    return x.select("doc_id", F.when(q & ~t, "regression_ready").when(q, "needs_check").otherwise("draft").alias("state"), F.when(t, "excluded").when(q, "kept").otherwise("review_pending").alias("ledger"), (q | (F.col("n_chars") > 4000)).alias("teaching"))


@query("""WITH r AS (SELECT lower(trim(text)) AS q, 'benchmark' AS origin FROM benchmark UNION ALL SELECT lower(trim(text)), 'conversation' FROM conversations WHERE turn = 0 UNION ALL SELECT lower(trim(split_part(text, chr(10), 1))), 'document' FROM documents) SELECT md5(regexp_replace(q, '\\s+', ' ', 'g')) AS query_md5, string_agg(DISTINCT origin, '+' ORDER BY origin) AS origins, count(*) AS n FROM r GROUP BY 1""")
def registered_queries(spark, d):
    """MSC-04: normalised questions of several registries, each once, with where it is registered."""
    one = lambda df, c, n: df.select(F.lower(F.trim(c)).alias("q"), F.lit(n).alias("origin"))
    r = one(table(spark, d, "benchmark"), F.col("text"), "benchmark").union(one(table(spark, d, "conversations").where("turn = 0"), F.col("text"), "conversation")).union(one(table(spark, d, "documents"), T.first_line(F.col("text")), "document"))
    return r.groupBy(F.md5(F.regexp_replace("q", r"\s+", " ").cast("binary")).alias("query_md5")).agg(F.array_join(F.array_sort(F.collect_set("origin")), "+").alias("origins"), F.count("*").alias("n"))


@query("""WITH l AS (SELECT conv_id, count(*) AS n, min(turn) AS a, max(turn) AS b FROM conversations WHERE contains(text, 'the') GROUP BY 1), c AS (SELECT DISTINCT conv_id FROM conversations) SELECT c.conv_id, CASE WHEN n IS NULL THEN 'no label' WHEN n = 1 THEN 'V' || a ELSE 'V' || a || '-V' || b END AS hint FROM c LEFT JOIN l USING (conv_id)""")
def feedback_hint(spark, d):
    """MSC-07: a hint by how many labels there are, with the first and the last."""
    g = table(spark, d, "conversations").groupBy("conv_id").agg(F.count_if(F.contains("text", F.lit("the"))).alias("n"), F.min(F.when(F.contains("text", F.lit("the")), F.col("turn"))).alias("a"), F.max(F.when(F.contains("text", F.lit("the")), F.col("turn"))).alias("b"))
    v = lambda c: F.concat(F.lit("V"), c)
    return g.select("conv_id", F.when(F.col("n") == 0, "no label").when(F.col("n") == 1, v("a")).otherwise(F.concat(v("a"), F.lit("-"), v("b"))).alias("hint"))


@query("""WITH p AS (SELECT DISTINCT conv_id FROM conversations) SELECT conv_id, side, rubric, CAST(NULL AS INTEGER) AS score FROM p, (VALUES ('A'), ('B')) s(side), (VALUES ('accuracy'), ('clarity'), ('scope')) r(rubric)""")
def review_template(spark, d):
    """MSC-14: pairs, sides and rubrics, to be filled in."""
    p = table(spark, d, "conversations").select("conv_id").distinct()
    return p.select("conv_id", F.explode(F.array(F.lit("A"), F.lit("B"))).alias("side")).select("conv_id", "side", F.explode(F.array(*map(F.lit, ("accuracy", "clarity", "scope")))).alias("rubric")).withColumn("score", F.lit(None).cast("int"))


@query("""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR))) AS i FROM labels), s AS (SELECT doc_id, CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8)) AS BIGINT) % 5 AS shard FROM labels) SELECT shard, count(*) AS n, count(DISTINCT doc_id) AS tests, CAST(sum(doc_id) AS BIGINT) AS ids FROM s GROUP BY 1""")
def shard_cover(spark, d):
    """GV-11: an exact cover of all cases by shards, by hash."""
    s = table(spark, d, "labels").select("doc_id", (F.conv(F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % 5).alias("shard"))
    return s.groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("tests"), F.sum("doc_id").alias("ids"))


@query("""WITH p AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, 'lang="([a-z]+)"', 1) AS lang, length(html) AS n FROM pages) SELECT page_id, lang, length(title) > 0 AND length(title) <= 200 AND lang IN ('en', 'de', 'fr', 'es') AND n BETWEEN 1 AND 7200 AS valid, CASE WHEN title = '' THEN 'title' WHEN lang NOT IN ('en', 'de', 'fr', 'es') THEN 'lang' WHEN n > 7200 THEN 'length' ELSE 'ok' END AS why FROM p""")
def metadata_check(spark, d):
    """MSC-03: parsed metadata, its form and its bounds."""
    p = table(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("html", 'lang="([a-z]+)"', 1).alias("lang"), F.length("html").alias("n"))
    ok = F.col("lang").isin("en", "de", "fr", "es")
    return p.select("page_id", "lang", (F.length("title").between(1, 200) & ok & F.col("n").between(1, 7200)).alias("valid"), F.when(F.col("title") == "", "title").when(~ok, "lang").when(F.col("n") > 7200, "length").otherwise("ok").alias("why"))


@query("""WITH c AS (SELECT conv_id, turn, role, length(text) AS n FROM conversations), x AS (SELECT conv_id, CASE WHEN conv_id % 11 = 0 AND turn = 2 THEN 'turn 1' ELSE 'turn ' || turn END AS key, turn, role, n, CASE WHEN turn % 5 = 4 THEN 'missing' WHEN conv_id % 11 = 0 AND turn = 2 THEN 'duplicate' END AS problem FROM c)
SELECT conv_id, key, CASE WHEN turn % 5 <> 4 THEN role END AS role, CAST(CASE WHEN turn % 5 <> 4 THEN n END AS INTEGER) AS n, problem FROM x""")
def review_document(spark, d):
    """SRC-05, GV-04, MSC-12: a review document a conversation, written as Markdown with fenced JSON and read back; sections without a block or with a key that came before are told."""
    c = table(spark, d, "conversations")
    key = F.when((F.col("conv_id") % 11 == 0) & (F.col("turn") == 2), "turn 1").otherwise(F.concat(F.lit("turn "), "turn"))
    body = F.when(F.col("turn") % 5 == 4, "nothing yet").otherwise(F.concat(F.lit("```json\n"), F.to_json(F.struct("role", F.length("text").alias("n"))), F.lit("\n```")))
    lines = F.array_sort(F.collect_list(F.struct("turn", F.concat(F.lit("### "), key, F.lit("\n"), body, F.lit("\n")).alias("s"))))
    doc = c.groupBy("conv_id").agg(F.concat(F.lit("# Review\n"), F.array_join(F.transform(lines, lambda x: x["s"]), "")).alias("text"))
    b = doc.select("conv_id", F.explode(review_blocks(F.col("text"))).alias("b")).select("conv_id", "b.*")
    got = F.from_json("json", "role string, n int")
    return b.select("conv_id", "key", got["role"].alias("role"), got["n"].alias("n"), "problem")


@query("""WITH s AS (SELECT doc_id, lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS k FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)), l AS (SELECT lang, count(*) AS labelled FROM documents JOIN labels USING (doc_id) GROUP BY 1)
SELECT lang, any_value(labelled) AS labelled, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY k) AS suggested FROM s JOIN l USING (lang) WHERE k <= 5 GROUP BY 1""")
def review_queue(spark, d):
    """GV-03/05: what is labelled already, and the first suggestions that aren't."""
    x, lab = table(spark, d, "documents"), table(spark, d, "labels").select("doc_id").distinct()
    s = x.join(lab, "doc_id", "left_anti").withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id"))).where("k <= 5")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "doc_id"))), lambda r: r["doc_id"].cast("string")), ",")
    return s.groupBy("lang").agg(ids.alias("suggested")).join(x.join(lab, "doc_id").groupBy("lang").agg(F.count("*").alias("labelled")), "lang").select("lang", "labelled", "suggested")


@query("""WITH s AS (SELECT source, lang, count(*) AS n, CAST(floor(avg(n_chars)) AS BIGINT) AS size FROM documents GROUP BY 1, 2) SELECT source, lang, CAST(row_number() OVER (PARTITION BY source ORDER BY size, lang) AS INTEGER) AS step, CASE WHEN n < 5 THEN 'short' WHEN size > 3000 THEN 'long' ELSE 'normal' END AS session, lag(lang) OVER (PARTITION BY source ORDER BY size, lang) AS after FROM s""")
def learning_path(spark, d):
    """CT-02: the parts of a topic from the shortest on, each after the one before it."""
    s = table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.floor(F.avg("n_chars")).alias("size"))
    w = Window.partitionBy("source").orderBy("size", "lang")
    return s.select("source", "lang", F.row_number().over(w).alias("step"), F.when(F.col("n") < 5, "short").when(F.col("size") > 3000, "long").otherwise("normal").alias("session"), F.lag("lang").over(w).alias("after"))


@query(r"""SELECT conv_id, turn, nullif(trim(regexp_extract(lower(text), '(?:^|[.]\s)([^.]{5,80}) that ', 1)), '') AS intended, contains(text, 'this') OR contains(text, 'der ') AS points, sha256(coalesce(nullif(trim(text), ''), role)) AS body FROM conversations""")
def intended_query(spark, d):
    """MSC-08: what was asked for, whether a text points at something, and the digest of its source's body."""
    t = F.col("text")
    asked = F.nullif(F.trim(F.regexp_extract(F.lower(t), r"(?:^|[.]\s)([^.]{5,80}) that ", 1)), F.lit(""))
    return table(spark, d, "conversations").select("conv_id", "turn", asked.alias("intended"), _has(t, ["this", "der "]).alias("points"), F.sha2(F.coalesce(F.nullif(F.trim(t), F.lit("")), F.col("role")).cast("binary"), 256).alias("body"))


@query("""WITH k AS (SELECT conv_id, CASE WHEN role = 'user' THEN 'question' WHEN length(text) > 300 THEN 'claim' ELSE 'note' END AS kind, turn FROM conversations) SELECT conv_id, kind, string_agg(CAST(turn AS VARCHAR), ',' ORDER BY turn) AS ids, count(*) AS n FROM k GROUP BY 1, 2""")
def ids_by_kind(spark, d):
    """MSC-15: ids flattened by kind."""
    kind = F.when(F.col("role") == "user", "question").when(F.length("text") > 300, "claim").otherwise("note")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("turn")), lambda x: x.cast("string")), ",")
    return table(spark, d, "conversations").groupBy("conv_id", kind.alias("kind")).agg(ids.alias("ids"), F.count("*").alias("n"))


@query("""WITH q AS (SELECT doc_id, quality, toxic FROM labels), p AS (SELECT lang, count(*) AS promoted, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS right_, count(*) FILTER (WHERE toxic = 1) AS adversarial, count(*) FILTER (WHERE toxic = 1 AND quality = 0) AS caught FROM q JOIN documents USING (doc_id) GROUP BY 1)
SELECT lang, promoted, adversarial, printf('%.1f%%', round(1000.0 * (right_ + caught) / greatest(1, promoted)) / 10) AS accuracy FROM p""")
def contract_accuracy(spark, d):
    """MSC-16/18: promoted and adversarial checks, and their accuracy as it is shown."""
    q = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id")
    right, caught = F.count_if((F.col("quality") == 1) & (F.col("toxic") == 0)), F.count_if((F.col("toxic") == 1) & (F.col("quality") == 0))
    g = q.groupBy("lang").agg(F.count("*").alias("promoted"), F.count_if(F.col("toxic") == 1).alias("adversarial"), (right + caught).alias("ok"))
    return g.select("lang", "promoted", "adversarial", F.format_string("%.1f%%", F.round(1000.0 * F.col("ok") / F.greatest(F.lit(1), "promoted")) / 10).alias("accuracy"))
