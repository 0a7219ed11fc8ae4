"""Windows, orders, samples and joins over conversations, events and the star schema (WIN-*, SRT-*, JON-*, SET-*, AGG-*)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenquery.operators import windows as W
from lumenquery.sources.tables import table


def context_window_pm2(spark, d):
    c = W.context(table(spark, d, "conversations"), "conv_id", "turn", "text", 2)
    return c.select("conv_id", "turn", F.md5(F.col("window").cast("binary")).alias("window_md5"), "w_start", "w_end")


def evidence_window_pm1(spark, d):
    c = W.context(table(spark, d, "conversations"), "conv_id", "turn", "text", 1)
    return c.where(F.contains("text", F.lit("the"))).select("conv_id", "turn", F.length("window").alias("n"), "w_start", "w_end")


def temporal_buckets(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "value")
    return W.bucket_best(e, "user_id", "at", "value", "event_id", 3).select("user_id", "bucket", "event_id")


def first_seen_dedup(spark, d):
    p = table(spark, d, "pages").select(F.regexp_extract("url", r"^[a-z]+://([^/:]+)", 1).alias("host"), "page_id", "url")
    return W.first_seen(p, "host", "page_id")


def monotonic_lag_check(spark, d):
    w = Window.partitionBy("user_id").orderBy("event_id")
    x = table(spark, d, "events").withColumn("before", F.lag("ts").over(w))
    return x.groupBy("user_id").agg(F.count_if(F.col("ts") < F.col("before")).alias("backwards"), F.count("*").alias("n"))


def sequence_gap(spark, d):
    """WIN-11."""
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.min("turn").alias("lo"), F.max("turn").alias("hi"), F.count("*").alias("n"), F.count_distinct("turn").alias("distinct_n"))
    return c.select("conv_id", ((F.col("hi") - F.col("lo") + 1 != F.col("n")) | (F.col("n") != F.col("distinct_n"))).alias("broken"), "n")


def top_n_per_group(spark, d):
    li = table(spark, d, "lineitem").join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    w = Window.partitionBy("p_brand").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")
    return li.withColumn("rank", F.row_number().over(w)).where("rank <= 5").select("p_brand", "rank", "l_orderkey", "l_linenumber", "l_extendedprice")


def actor_forward_fill(spark, d):
    """WIN-14: the actor of the last row that names one."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "conversations").select("conv_id", "turn", F.last(F.when(F.col("role") != "assistant", F.col("role")), True).over(w).alias("actor"))


def role_unpivot_merge(spark, d):
    """PRJ-06: one row a text with its sorted roles."""
    c = table(spark, d, "conversations")
    return c.groupBy("conv_id", F.md5(F.col("text").cast("binary")).alias("text_md5")).agg(F.array_join(F.sort_array(F.collect_set("role")), ",").alias("roles"), F.min("turn").alias("first_turn"))


def time_range_semi(spark, d):
    """FLT-04: rows inside any of a few ranges."""
    ranges = spark.createDataFrame([(1, 30), (100, 160), (500, 505)], "lo long, hi long")
    e = table(spark, d, "events").select("event_id", "user_id", "event_type")
    return e.join(F.broadcast(ranges), (e.user_id >= ranges.lo) & (e.user_id <= ranges.hi), "left_semi")


def new_arrivals_anti(spark, d):
    """JON-04: customers that no order in progress knows."""
    o = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(o, "c_custkey", "left_anti").select("c_custkey", "c_name")


def mapping_semi(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(o, "c_custkey", "left_semi").select("c_custkey", "c_mktsegment")


def lookup_default(spark, d):
    """JON-01/02: lookups with a bucket for what is missing."""
    x = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return x.groupBy("lang", F.coalesce(F.col("quality").cast("string"), F.lit("missing")).alias("quality")).agg(F.count("*").alias("n"))


def five_way_ledger(spark, d):
    """JON-03: four left joins, precedence by coalesce, drift."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), "o_orderstatus", "o_orderpriority")
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey", "n_name")
    r = table(spark, d, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    li = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count_if(F.col("l_returnflag") == "R").alias("returned"))
    j = o.join(c, "c_custkey", "left").join(F.broadcast(n), "c_nationkey", "left").join(F.broadcast(r), "n_regionkey", "left").join(li, "o_orderkey", "left")
    review = F.when(F.col("returned") > 2, "returned")
    evidence = F.when(F.col("c_acctbal") < 0, "debt")
    auto = F.when(F.col("o_orderstatus") == "F", "closed").otherwise("open")
    return j.select("o_orderkey", F.coalesce("r_name", F.lit("missing")).alias("region"), F.coalesce(review, evidence, auto).alias("decision"), (F.coalesce(review, evidence).isNotNull() & (auto == "open")).alias("drift"))


def layer_full_outer(spark, d):
    """JON-13, AGG-04: two layers of signals a key, each clamped, added over the full outer join."""
    e = table(spark, d, "events")
    layer = lambda a, b, wa, wb: e.where(F.col("event_type").isin(a, b)).groupBy("user_id").agg(F.sum(F.when(F.col("event_type") == a, wa).otherwise(wb)).alias("s"))
    clamp = lambda c: F.greatest(F.lit(-12), F.least(F.lit(12), c))
    g, loc = layer("purchase", "error", 6, -10).select("user_id", clamp(F.col("s")).alias("g")), layer("signup", "view", 8, -2).select("user_id", clamp(F.col("s")).alias("l"))
    return g.join(loc, "user_id", "full").select("user_id", F.coalesce("g", F.lit(0)).alias("global_part"), F.coalesce("l", F.lit(0)).alias("local_part"), (F.coalesce("g", F.lit(0)) + F.coalesce("l", F.lit(0))).alias("total"))


def status_counts(spark, d):
    return table(spark, d, "orders").groupBy(F.coalesce("o_orderstatus", F.lit("")).alias("status")).agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("customers"), F.max("o_orderdate").alias("latest"))


def status_partition(spark, d):
    """JON-21: two tables reconciled: every order is ready, pending or excluded by its lines, and the classes add up; the latest ready one."""
    li = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("lines"), F.count_if(F.col("l_returnflag") == "R").alias("back"))
    o = table(spark, d, "orders").join(li, "o_orderkey", "full")
    ready = F.col("o_orderstatus").isNotNull() & (F.coalesce("lines", F.lit(0)) > 0) & (F.coalesce("back", F.lit(0)) == 0)
    pending = F.col("o_orderstatus").isNotNull() & F.col("lines").isNull()
    excluded = F.coalesce("back", F.lit(0)) > 0
    x = o.select("o_orderkey", "o_orderdate", ready.alias("ready"), pending.alias("pending"), excluded.alias("excluded"), F.col("o_orderstatus").isNull().alias("unknown"))
    a = x.agg(F.count("*").alias("collected"), *[F.count_if(c).alias(c) for c in ("ready", "pending", "excluded", "unknown")], F.max_by("o_orderkey", F.when(F.col("ready"), F.struct("o_orderdate", "o_orderkey"))).alias("latest_ready"))
    return a.withColumn("reconciled", F.expr("ready + pending + excluded + unknown = collected"))


def preference_counts(spark, d):
    """AGG-07."""
    e = table(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "view").alias("views"), F.count_if(F.col("event_type") == "click").alias("clicks"))
    return e.where("views >= 2 and clicks >= 2").select("user_id", F.when(F.col("views") > F.col("clicks"), "reader").when(F.col("clicks") > F.col("views"), "actor").otherwise("even").alias("kind"))


def family_intersection(spark, d):
    """AGG-11: members of all of a family's sets."""
    e = table(spark, d, "events").where("event_type in ('click', 'purchase', 'signup')")
    return e.groupBy("user_id").agg(F.countDistinct("event_type").alias("k"), F.count("*").alias("n")).where("k = 3").select("user_id", "n")


def eighteen_key_order(spark, d):
    """SRT-03: an order by eighteen keys within groups, as row numbers."""
    c = F.col
    keys = [
        F.desc("l_returnflag"), "l_linestatus", F.desc(c("l_discount") > 0.05), F.desc(c("l_quantity") > 25), F.desc(c("l_tax") < 0.02), F.desc(c("l_quantity") > 40), F.desc(c("l_orderkey") % 2 == 0), F.desc(c("l_linenumber") > 3),
        F.desc(c("l_discount") > 0.02), F.desc(c("l_extendedprice") > 30000), F.desc(F.year("l_shipdate")), F.month("l_shipdate"), "l_shipdate", F.desc("l_extendedprice"), "l_tax", "l_partkey", "l_orderkey", "l_linenumber",
    ]
    x = table(spark, d, "lineitem").withColumn("rank", F.row_number().over(Window.partitionBy("l_suppkey").orderBy(*keys)))
    return x.where("rank <= 10").select("l_suppkey", "rank", "l_orderkey", "l_linenumber")


def even_sample(spark, d):
    return W.even_sample(table(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey", 12).select("pos", "c_custkey")


def shard_mod(spark, d):
    """SRT-11: an exact cover by position."""
    x = W.numbered(table(spark, d, "supplier"), ["s_suppkey"])
    return x.groupBy((F.col("pos") % 4).cast("int").alias("shard")).agg(F.count("*").alias("n"), F.sum("s_suppkey").alias("keys"))


def apportion(spark, d):
    c = table(spark, d, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("w"))
    return W.apportion(c, "c_mktsegment", "w", 90)


def scd_revisions(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "ts", "event_type")
    return W.revisions(e, "user_id", ["ts", "event_id"], F.col("event_type")).select("user_id", "event_id", "revision", "superseded")


def latest_state(spark, d):
    """WIN-13, ST-02."""
    e = table(spark, d, "events")
    last = F.max_by(F.struct("event_type", "event_id"), F.struct("ts", "event_id"))
    return e.groupBy("user_id").agg(last.alias("s"), F.count("*").alias("attempts")).select("user_id", F.col("s.event_type").alias("status"), F.col("s.event_id").alias("last_event"), "attempts")


def freshness_report(spark, d):
    """ST-06: ages against limits, the worst status."""
    now = F.to_timestamp_ntz(F.lit("2024-12-31 00:00:00"))
    x = table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("last"))
    age = F.expr("timestampdiff(DAY, last, to_timestamp_ntz('2024-12-31 00:00:00'))")
    return x.select("user_id", age.cast("long").alias("age_days"), F.when(age > 30, "stale").when(age > 7, "due").when(F.col("last") > now, "future").otherwise("fresh").alias("status"))


def rollup_sales(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.rollup("c_mktsegment", "o_orderstatus").agg(F.round(F.sum("o_totalprice"), 2).alias("total"), F.count("*").alias("n"), F.grouping_id().alias("level"))


def cube_sales(spark, d):
    li = table(spark, d, "lineitem")
    return li.cube("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("qty"), F.round(F.avg("l_discount"), 4).alias("avg_discount"), F.count("*").alias("n"))


def grouping_sets_sales(spark, d):
    for t in ("orders", "customer", "nation"):
        table(spark, d, t).createOrReplaceTempView(f"gs_{t}")
    return spark.sql("SELECT n_name, o_orderpriority, count(*) AS n FROM gs_orders JOIN gs_customer ON o_custkey = c_custkey JOIN gs_nation ON c_nationkey = n_nationkey GROUP BY GROUPING SETS ((n_name), (o_orderpriority), ())")


def union_intersect_except(spark, d):
    """SET-01..05."""
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).distinct()
    s = table(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("k")).distinct()
    tag = lambda df, t: df.select(F.lit(t).alias("op"), "k")
    return tag(c.union(s).distinct(), "union").union(tag(c.intersect(s), "intersect")).union(tag(c.exceptAll(s), "except"))


def analytic_functions(spark, d):
    w = Window.partitionBy("o_orderpriority").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, d, "orders")
    return o.select("o_orderkey", F.lag("o_orderkey").over(w).alias("before"), F.lead("o_orderkey", 2).over(w).alias("after2"), F.ntile(4).over(w).alias("quarter"), F.dense_rank().over(Window.partitionBy("o_orderpriority").orderBy("o_orderstatus")).alias("dense"))


def pricing_summary(spark, d):
    li = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.to_timestamp_ntz(F.lit("1998-09-02 00:00:00")))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


def greedy_window_topk(spark, d):
    """JON-12: windows with a hit, scored, the best that don't overlap; each choice depends on the last."""
    c = W.context(table(spark, d, "conversations"), "conv_id", "turn", "text", 1)
    x = c.select("conv_id", "w_start", "w_end", (F.length("window") % 101).alias("score")).where("score > 20")
    return W.greedy_windows(x, "conv_id", 3)


def diversify_cover(spark, d):
    """SRT-07 over documents' topics, a language a group."""
    marks = ["tion", "ment", "able", "lich", "eau", "ado"]
    c = F.array_compact(F.array(*[F.when(F.contains("text", F.lit(m)), m) for m in marks]))
    x = table(spark, d, "documents").select(F.col("lang").alias("unit"), F.col("doc_id").alias("item"), c.alias("concepts"), F.col("n_chars").alias("score"))
    return W.diversify(x, "unit", 5)


QUERIES = {f.__name__: f for f in (context_window_pm2, evidence_window_pm1, temporal_buckets, first_seen_dedup, monotonic_lag_check, sequence_gap, top_n_per_group, actor_forward_fill, role_unpivot_merge, time_range_semi, new_arrivals_anti, mapping_semi, lookup_default, five_way_ledger, layer_full_outer, status_counts, status_partition, preference_counts, family_intersection, eighteen_key_order, even_sample, shard_mod, apportion, scd_revisions, latest_state, freshness_report, rollup_sales, cube_sales, grouping_sets_sales, union_intersect_except, analytic_functions, pricing_summary, greedy_window_topk, diversify_cover)}

_WIN = "string_agg(text, ' ' ORDER BY turn) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN {0} PRECEDING AND {0} FOLLOWING)"
_EDGE = "{1}(turn) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN {0} PRECEDING AND {0} FOLLOWING)"
_CLAMP = "greatest(-12, least(12, sum(CASE WHEN event_type = '{0}' THEN {2} ELSE {3} END)))"



def _greedy_sql(rounds: int) -> str:
    """The choices one after the other: each round takes the best that overlaps none before it."""
    out = ["w AS (SELECT conv_id, string_agg(text, ' ') OVER v AS win, min(turn) OVER v AS w_start, max(turn) OVER v AS w_end FROM conversations WINDOW v AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING))", "x AS (SELECT conv_id, w_start, w_end, CAST(length(win) % 101 AS INTEGER) AS score FROM w WHERE length(win) % 101 > 20)", "t0 AS (SELECT * FROM x WHERE false)"]
    for k in range(1, rounds + 1):
        free = f"NOT EXISTS (SELECT 1 FROM t{k - 1} t WHERE t.conv_id = x.conv_id AND x.w_end >= t.w_start AND x.w_start <= t.w_end)"
        out.append(f"t{k} AS (SELECT * FROM t{k - 1} UNION ALL (SELECT * FROM x WHERE {free} QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, w_start, w_end) = 1))")
    return f"WITH {', '.join(out)} SELECT * FROM t{rounds}"


def _cover_sql(rounds: int) -> str:
    """Each round takes the row with the most new concepts."""
    marks = ", ".join(f"CASE WHEN contains(text, '{m}') THEN '{m}' END" for m in ("tion", "ment", "able", "lich", "eau", "ado"))
    out = [f"x AS (SELECT lang AS unit, doc_id AS item, list_filter([{marks}], lambda m: m IS NOT NULL) AS concepts, n_chars AS score FROM documents)", "p0 AS (SELECT unit, item, concepts, 0 AS pick FROM x WHERE false)"]
    for k in range(1, rounds + 1):
        seen = f"(SELECT unit, flatten(list(concepts)) AS seen FROM p{k - 1} GROUP BY unit)"
        new = "len(list_filter(concepts, lambda m: NOT list_contains(coalesce(seen, []), m)))"
        out.append(f"p{k} AS (SELECT * FROM p{k - 1} UNION ALL (SELECT x.unit, item, concepts, {k} FROM x LEFT JOIN {seen} s ON s.unit = x.unit WHERE item NOT IN (SELECT item FROM p{k - 1}) QUALIFY row_number() OVER (PARTITION BY x.unit ORDER BY {new} DESC, score DESC, item) = 1))")
    return f"WITH {', '.join(out)} SELECT unit, pick, item FROM p{rounds}"


ORACLES = {
    "greedy_window_topk": _greedy_sql(3),
    "diversify_cover": _cover_sql(5),
    "context_window_pm2": f"SELECT conv_id, turn, md5({_WIN.format(2).replace(' ORDER BY turn)', ')', 1)}) AS window_md5, {_EDGE.format(2, 'min')} AS w_start, {_EDGE.format(2, 'max')} AS w_end FROM conversations",
    "evidence_window_pm1": f"WITH w AS (SELECT conv_id, turn, text, {_WIN.format(1).replace(' ORDER BY turn)', ')', 1)} AS win, {_EDGE.format(1, 'min')} AS w_start, {_EDGE.format(1, 'max')} AS w_end FROM conversations) SELECT conv_id, turn, CAST(length(win) AS INTEGER) AS n, w_start, w_end FROM w WHERE contains(text, 'the')",
    "temporal_buckets": """WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS a, value FROM events), b AS (SELECT *, min(a) OVER (PARTITION BY user_id) AS lo, max(a) OVER (PARTITION BY user_id) AS hi FROM e),
k AS (SELECT user_id, event_id, value, least(2, CAST(floor(CAST((a - lo) * 3 AS DOUBLE) / greatest(hi - lo, 1)) AS BIGINT)) AS bucket FROM b), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, bucket ORDER BY value DESC, event_id) AS n FROM k) SELECT user_id, bucket, event_id FROM r WHERE n = 1""",
    "first_seen_dedup": "WITH p AS (SELECT regexp_extract(url, '^[a-z]+://([^/:]+)', 1) AS host, page_id, url FROM pages), r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY page_id) AS n FROM p) SELECT host, page_id, url FROM r WHERE n = 1",
    "monotonic_lag_check": "WITH x AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) SELECT user_id, count(*) FILTER (WHERE ts < b) AS backwards, count(*) AS n FROM x GROUP BY user_id",
    "sequence_gap": "SELECT conv_id, max(turn) - min(turn) + 1 <> count(*) OR count(*) <> count(DISTINCT turn) AS broken, count(*) AS n FROM conversations GROUP BY conv_id",
    "top_n_per_group": "WITH r AS (SELECT p_brand, l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (PARTITION BY p_brand ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank FROM lineitem JOIN part ON l_partkey = p_partkey) SELECT p_brand, CAST(rank AS INTEGER) AS rank, l_orderkey, l_linenumber, l_extendedprice FROM r WHERE rank <= 5",
    "actor_forward_fill": "SELECT conv_id, turn, last_value(CASE WHEN role <> 'assistant' THEN role END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS actor FROM conversations",
    "role_unpivot_merge": "SELECT conv_id, md5(text) AS text_md5, array_to_string(list_sort(list(DISTINCT role)), ',') AS roles, min(turn) AS first_turn FROM conversations GROUP BY 1, 2",
    "time_range_semi": "SELECT event_id, user_id, event_type FROM events WHERE EXISTS (SELECT 1 FROM (VALUES (1, 30), (100, 160), (500, 505)) r(lo, hi) WHERE user_id BETWEEN lo AND hi)",
    "new_arrivals_anti": "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')",
    "mapping_semi": "SELECT c_custkey, c_mktsegment FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')",
    "lookup_default": "SELECT lang, coalesce(CAST(quality AS VARCHAR), 'missing') AS quality, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1, 2",
    "five_way_ledger": """WITH li AS (SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag = 'R') AS returned FROM lineitem GROUP BY 1),
j AS (SELECT o_orderkey, r_name, CASE WHEN returned > 2 THEN 'returned' END AS a, CASE WHEN c_acctbal < 0 THEN 'debt' END AS b, CASE WHEN o_orderstatus = 'F' THEN 'closed' ELSE 'open' END AS c
FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN li ON l_orderkey = o_orderkey)
SELECT o_orderkey, coalesce(r_name, 'missing') AS region, coalesce(a, b, c) AS decision, coalesce(a, b) IS NOT NULL AND c = 'open' AS drift FROM j""",
    "layer_full_outer": f"""WITH g AS (SELECT user_id, {_CLAMP.format('purchase', 'error', 6, -10)} AS g FROM events WHERE event_type IN ('purchase', 'error') GROUP BY 1), l AS (SELECT user_id, {_CLAMP.format('signup', 'view', 8, -2)} AS l FROM events WHERE event_type IN ('signup', 'view') GROUP BY 1)
SELECT user_id, CAST(coalesce(g, 0) AS BIGINT) AS global_part, CAST(coalesce(l, 0) AS BIGINT) AS local_part, CAST(coalesce(g, 0) + coalesce(l, 0) AS BIGINT) AS total FROM g FULL JOIN l USING (user_id)""",
    "status_counts": "SELECT coalesce(o_orderstatus, '') AS status, count(*) AS n, count(DISTINCT o_custkey) AS customers, max(o_orderdate) AS latest FROM orders GROUP BY 1",
    "status_partition": """WITH li AS (SELECT l_orderkey, count(*) AS lines, count(*) FILTER (WHERE l_returnflag = 'R') AS back FROM lineitem GROUP BY 1),
x AS (SELECT coalesce(o_orderkey, l_orderkey) AS k, o_orderdate, o_orderstatus IS NOT NULL AND coalesce(lines, 0) > 0 AND coalesce(back, 0) = 0 AS r, o_orderstatus IS NOT NULL AND lines IS NULL AS p, coalesce(back, 0) > 0 AS e, o_orderstatus IS NULL AS u FROM orders FULL JOIN li ON l_orderkey = o_orderkey)
SELECT count(*) AS collected, count(*) FILTER (WHERE r) AS ready, count(*) FILTER (WHERE p) AS pending, count(*) FILTER (WHERE e) AS excluded, count(*) FILTER (WHERE u) AS unknown, (SELECT k FROM x WHERE r ORDER BY o_orderdate DESC, k DESC LIMIT 1) AS latest_ready, count(*) FILTER (WHERE r) + count(*) FILTER (WHERE p) + count(*) FILTER (WHERE e) + count(*) FILTER (WHERE u) = count(*) AS reconciled FROM x""",
    "preference_counts": "WITH e AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'view') AS v, count(*) FILTER (WHERE event_type = 'click') AS c FROM events GROUP BY 1) SELECT user_id, CASE WHEN v > c THEN 'reader' WHEN c > v THEN 'actor' ELSE 'even' END AS kind FROM e WHERE v >= 2 AND c >= 2",
    "family_intersection": "SELECT user_id, count(*) AS n FROM events WHERE event_type IN ('click', 'purchase', 'signup') GROUP BY 1 HAVING count(DISTINCT event_type) = 3",
    "eighteen_key_order": "WITH r AS (SELECT l_suppkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_returnflag DESC, l_linestatus, (l_discount > 0.05) DESC, (l_quantity > 25) DESC, (l_tax < 0.02) DESC, (l_quantity > 40) DESC, (l_orderkey % 2 = 0) DESC, (l_linenumber > 3) DESC, (l_discount > 0.02) DESC, (l_extendedprice > 30000) DESC, year(l_shipdate) DESC, month(l_shipdate), l_shipdate, l_extendedprice DESC, l_tax, l_partkey, l_orderkey, l_linenumber) AS rank FROM lineitem) SELECT l_suppkey, CAST(rank AS INTEGER) AS rank, l_orderkey, l_linenumber FROM r WHERE rank <= 10",
    "even_sample": "WITH p AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS pos FROM customer), s AS (SELECT DISTINCT CAST(round_even(i * ((SELECT count(*) FROM customer) - 1) / 11.0, 0) AS BIGINT) AS pos FROM range(12) t(i)) SELECT pos, c_custkey FROM p JOIN s USING (pos)",
    "shard_mod": "WITH p AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS pos FROM supplier) SELECT CAST(pos % 4 AS INTEGER) AS shard, count(*) AS n, CAST(sum(s_suppkey) AS BIGINT) AS keys FROM p GROUP BY 1",
    "apportion": "WITH c AS (SELECT c_mktsegment, count(*) * (90 - (SELECT count(DISTINCT c_mktsegment) FROM customer)) / (SELECT count(*) FROM customer) AS e FROM customer GROUP BY 1), r AS (SELECT c_mktsegment, floor(e) + 1 AS b, row_number() OVER (ORDER BY round(e - floor(e), 9) DESC, c_mktsegment) AS k, 90 - sum(floor(e) + 1) OVER () AS l FROM c) SELECT c_mktsegment, CAST(b + CASE WHEN k <= l THEN 1 ELSE 0 END AS BIGINT) AS share FROM r",
    "scd_revisions": "WITH x AS (SELECT user_id, event_id, ts, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events), y AS (SELECT * FROM x WHERE b IS NULL OR b <> event_type) SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS revision, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NOT NULL AS superseded FROM y",
    "latest_state": "WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k, count(*) OVER (PARTITION BY user_id) AS attempts FROM events) SELECT user_id, event_type AS status, event_id AS last_event, attempts FROM r WHERE k = 1",
    "freshness_report": "WITH x AS (SELECT user_id, max(ts) AS last FROM events GROUP BY 1), a AS (SELECT user_id, last, date_sub('day', last, TIMESTAMP '2024-12-31 00:00:00') AS age FROM x) SELECT user_id, age AS age_days, CASE WHEN age > 30 THEN 'stale' WHEN age > 7 THEN 'due' WHEN last > TIMESTAMP '2024-12-31 00:00:00' THEN 'future' ELSE 'fresh' END AS status FROM a",
    "rollup_sales": "SELECT c_mktsegment, o_orderstatus, round(sum(o_totalprice), 2) AS total, count(*) AS n, CAST(grouping(c_mktsegment, o_orderstatus) AS BIGINT) AS level FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ROLLUP (c_mktsegment, o_orderstatus)",
    "cube_sales": "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS qty, round(avg(l_discount), 4) AS avg_discount, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "grouping_sets_sales": "SELECT n_name, o_orderpriority, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY GROUPING SETS ((n_name), (o_orderpriority), ())",
    "union_intersect_except": "WITH c AS (SELECT DISTINCT c_nationkey AS k FROM customer), s AS (SELECT DISTINCT s_nationkey AS k FROM supplier WHERE s_acctbal > 5000) SELECT 'union' AS op, k FROM (SELECT k FROM c UNION SELECT k FROM s) UNION ALL SELECT 'intersect', k FROM (SELECT k FROM c INTERSECT SELECT k FROM s) UNION ALL SELECT 'except', k FROM (SELECT k FROM c EXCEPT SELECT k FROM s)",
    "analytic_functions": "SELECT o_orderkey, lag(o_orderkey) OVER w AS before, lead(o_orderkey, 2) OVER w AS after2, CAST(ntile(4) OVER w AS INTEGER) AS quarter, CAST(dense_rank() OVER (PARTITION BY o_orderpriority ORDER BY o_orderstatus) AS INTEGER) AS dense FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey)",
    "pricing_summary": "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY 1, 2",
}
