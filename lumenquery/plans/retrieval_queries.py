"""Retrieval over documents: index, ranking, policies, fusion (RT-*, QU-*, JON-06..10, SRT-*, AGG-02/05, WIN-04, EV-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenquery.functions import text as T
from lumenquery.operators import questions as Q
from lumenquery.operators import retrieval as R
from lumenquery.sources.stored import once
from lumenquery.sources.tables import table

from .text_queries import NORM, TITLE

#: The question's terms with their weights: originals, an equivalent, a directed expansion.
TERMS = {"thering": 3.5, "ation": 1.8, "stle": 0.55}
QUERY, EXCLUDED, EXPANDED = "theringation", ["shouting", "oneris"], ["essh", "thwas"]
TOPICS = [("endings", ["tion", "able"], ["the"], 3), ("french", ["eau", "ment"], ["que"], 4), ("german", ["erbe", "lich"], [], 5)]


def _fields(spark, d):
    """Normalised once, as long as the documents stand; every query reads it."""
    return once(spark, "fields", [f"{d}/documents.parquet"], lambda: R.fields(table(spark, d, "documents")))


def rank_bm25f(spark, d):
    """The flagship: top 12 of the weighted terms."""
    return R.bm25f(_fields(spark, d), TERMS).orderBy(F.desc("bm25"), "doc_id").limit(12)


def bm25f_scores(spark, d):
    return R.bm25f(_fields(spark, d), TERMS)


def inverted_index_postings(spark, d):
    return R.term_stats(_fields(spark, d), list(TERMS))


def field_avg_len(spark, d):
    f = _fields(spark, d)
    return f.groupBy("lang").agg(F.round(F.avg(F.length("title")), 4).alias("avg_title"), F.round(F.avg(F.length("body")), 4).alias("avg_body"), F.count("*").alias("n"))


def gram_channel(spark, d):
    return R.gram_channel(_fields(spark, d), QUERY)


def _hybrid(spark, d):
    f = _fields(spark, d)
    score, gram = R.bm25f(f, TERMS), R.gram_channel(f, QUERY)
    hit = lambda c, ts: sum((F.when(F.contains(F.col(c), F.lit(t)), 1).otherwise(0) for t in ts), F.lit(0))
    x = f.select("doc_id", hit("title", TERMS).alias("ct"), hit("body", TERMS).alias("cb"), hit("body", EXCLUDED).alias("seed"), hit("body", EXPANDED).alias("only"))
    j = x.join(score, "doc_id", "left").join(gram, "doc_id", "left").na.fill(0.0, ["bm25", "gram_score"])
    j = j.withColumn("tier", R.tier(F.col("ct"), F.col("cb"), F.col("cb") >= 1, F.col("gram_score") > 0)).where("tier is not null")
    bonus = F.create_map(*[v for k, b in R.TIER_BONUS.items() for v in (F.lit(k), F.lit(b))])[F.col("tier")]
    total = F.round(F.col("bm25") + F.col("gram_score") + 4 * F.col("cb"), 4)
    return j.select("doc_id", "tier", total.alias("score"), R.exclusion_penalty(F.col("seed"), F.col("only")).alias("penalty"), F.round(total + bonus - R.exclusion_penalty(F.col("seed"), F.col("only")), 4).alias("effective"))


def hybrid_rank(spark, d):
    return _hybrid(spark, d)


def review_budget(spark, d):
    h = _hybrid(spark, d)
    return R.review_budget(h, F.col("tier").isin("direct", "strong_related"), [F.desc("effective"), "doc_id"], 24).select("doc_id", "review_rank", "in_budget")


def manifest_page(spark, d):
    return R.page(_hybrid(spark, d), [F.desc("effective"), "doc_id"], 20, 20, 60).select("doc_id", "pos", "effective")


def topic_rule_score(spark, d):
    rules = spark.createDataFrame(TOPICS, "topic string, keywords array<string>, context_any array<string>, minimum int")
    return R.topic_scores(_fields(spark, d), rules)


def topic_coverage(spark, d):
    """AGG-14: assigned, fallback, several topics."""
    s = topic_rule_score(spark, d).groupBy("doc_id").agg(F.count("*").alias("k"))
    x = table(spark, d, "documents").select("doc_id", "lang").join(s, "doc_id", "left")
    return x.groupBy("lang").agg(F.count("k").alias("assigned"), F.count_if(F.col("k").isNull()).alias("fallback"), F.count_if(F.col("k") > 1).alias("multi"))


def topic_relative_topk(spark, d):
    return R.relative_topk(topic_rule_score(spark, d), "topic", "score", "doc_id", 8.0, 0.4, 6)


def term_overlaps(spark, d):
    """JON-10: occurrences of nested terms in whole texts, those inside longer ones dropped; places from 0."""
    terms = ["the", "ther", "there", "her", "tion", "ation"]
    hits = Q.occurrences(_fields(spark, d).select(F.col("doc_id").alias("key"), "body"), ["key"], "body", terms)
    return R.longest_non_overlapping(hits)


def fusion_argmin(spark, d):
    """RT-10/11: three questions, each ranked; the best row of each document."""
    f = _fields(spark, d)
    units = None
    for name, weights in (("q1", TERMS), ("q2", {"tion": 3.5, "ment": 1.8}), ("q3", {"able": 3.5})):
        s = R.bm25f(f, weights)
        top = R.page(s, [F.desc("bm25"), "doc_id"], 0, 40, 40).select("doc_id", F.lit(name).alias("unit"), F.col("pos").alias("rank"), F.when(F.col("n_terms") > 1, "direct").otherwise("strong_related").alias("tier"), F.col("bm25").alias("score"))
        units = top if units is None else units.unionByName(top)
    return R.fuse(units)


def two_pool_quota(spark, d):
    h = _hybrid(spark, d).join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    return R.two_pools(h, (F.col("quality") == 1) & (F.col("tier") == "direct"), [F.desc("effective"), "doc_id"], 6, 4).select("doc_id", "pool", "pool_rank", "outcome")


def retrieval_policy(spark, d):
    """RT-07, AGG-06, EV-09: eligibility and reasons as data, then a histogram of the reasons."""
    h = _hybrid(spark, d).join(table(spark, d, "labels").select("doc_id", "quality", "toxic"), "doc_id", "left")
    reason = F.when(F.col("quality").isNull(), "unlabelled").when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low_quality").when(F.col("penalty") > 0, "excluded_term").otherwise("eligible")
    return h.groupBy("tier", reason.alias("reason")).agg(F.count("*").alias("n"), F.max("effective").alias("best"))


def recall_gate(spark, d):
    """FLT-05."""
    h = _hybrid(spark, d)
    return h.where((F.col("tier") != "semantic_lead") | (F.col("score") >= 12)).select("doc_id", "tier")


def embedding_topk_cosine(spark, d):
    """The semantic channel: cosine of every vector with the stated queries, ids divisible by 20; three best each."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return R.cosine_topk(e, e.where("id % 20 = 0"), 3)


QUERIES = {f.__name__: f for f in (rank_bm25f, bm25f_scores, inverted_index_postings, field_avg_len, gram_channel, hybrid_rank, review_budget, manifest_page, topic_rule_score, topic_coverage, topic_relative_topk, term_overlaps, fusion_argmin, two_pool_quota, retrieval_policy, recall_gate, embedding_topk_cosine)}

_F = f"f AS (SELECT doc_id, lang, {NORM.format(TITLE)} AS title, {NORM.format('text')} AS body FROM documents)"


def _occ(c, t):
    return f"(length({c}) - length(replace({c}, '{t}', ''))) // {len(t)}"


def _stats(terms, name="p"):
    rows = " UNION ALL ".join(f"SELECT doc_id, length(title) AS len_title, length(body) AS len_body, '{t}' AS term, {_occ('title', t)} AS tf_title, {_occ('body', t)} AS tf_body, {w} AS w FROM f" for t, w in terms.items())
    return f"{name} AS (SELECT * FROM ({rows}) WHERE tf_title + tf_body > 0)"


def _bm25(terms, name="s", p="p"):
    part = lambda n, w: f"{w} * least(tf_{n}, 8) * 2.35 / (least(tf_{n}, 8) + 1.35 * (1 - 0.72 + 0.72 * len_{n} / greatest(1.0, avg_{n})))"
    return f"""{_stats(terms, p)}, {name} AS (SELECT doc_id, round(sum(w * ln(1 + (n - df + 0.5) / (df + 0.5)) * (CAST({part('title', 4.0)} AS DOUBLE) + CAST({part('body', 1.0)} AS DOUBLE))), 4) AS bm25, count(*) AS n_terms
FROM {p} JOIN (SELECT term, count(*) AS df FROM {p} GROUP BY term) USING (term), (SELECT count(*) AS n, round(avg(length(title)), 4) AS avg_title, round(avg(length(body)), 4) AS avg_body FROM f) GROUP BY doc_id)"""


_Q = sorted({QUERY[i : i + 2] for i in range(len(QUERY) - 1)})
_GLIST = "[" + ", ".join(f"'{g}'" for g in _Q) + "]"
_GRAM = f"""gx AS (SELECT doc_id, title, body, unnest({_GLIST}) AS g FROM f), gd AS (SELECT g, ln(1 + ((SELECT count(*) FROM f) + 1.0) / (count(*) + 1)) AS w FROM gx WHERE contains(title, g) OR contains(body, g) GROUP BY g),
gs AS (SELECT doc_id, coalesce(sum(w) FILTER (WHERE contains(title, g)), 0) / greatest(1.0, (SELECT sum(w) FROM gd)) AS ct, sum(w) FILTER (WHERE contains(body, g)) / greatest(1.0, (SELECT sum(w) FROM gd)) AS cb,
count(*) FILTER (WHERE contains(title, g)) AS nt, count(*) FILTER (WHERE contains(body, g)) AS nb FROM gx JOIN gd USING (g) GROUP BY doc_id),
gram AS (SELECT doc_id, round(24 * ct + 14 * cb, 4) AS gram_score FROM gs WHERE greatest(nt, nb) >= 2 AND greatest(ct, cb) >= 0.12)"""


def _hits(c, ts):
    return " + ".join(f"CAST(contains({c}, '{t}') AS INTEGER)" for t in ts)


_HYBRID = f"""{_F}, {_bm25(TERMS)}, {_GRAM}, hx AS (SELECT f.doc_id, {_hits('title', TERMS)} AS ct, {_hits('body', TERMS)} AS cb, {_hits('body', EXCLUDED)} AS seed, {_hits('body', EXPANDED)} AS only_, coalesce(bm25, 0) AS bm25, coalesce(gram_score, 0) AS gram_score
FROM f LEFT JOIN s ON f.doc_id = s.doc_id LEFT JOIN gram ON f.doc_id = gram.doc_id),
ht AS (SELECT doc_id, CASE WHEN ct >= 2 THEN 'direct' WHEN cb >= 2 OR ct >= 1 THEN 'strong_related' WHEN cb >= 1 THEN 'topic_related' WHEN gram_score > 0 THEN 'semantic_lead' END AS tier, round(bm25 + gram_score + 4 * cb, 4) AS score, 150 * least(3, seed) + 20 * least(3, only_) AS penalty FROM hx),
h AS (SELECT doc_id, tier, score, penalty, round(score + CASE tier WHEN 'direct' THEN 12.0 WHEN 'strong_related' THEN 6.0 WHEN 'topic_related' THEN 1.0 ELSE 0.0 END - penalty, 4) AS effective FROM ht WHERE tier IS NOT NULL)"""
_TOPIC = _F + ", t AS (" + " UNION ALL ".join(
    f"SELECT doc_id, '{n}' AS topic, 6 * ({' + '.join(_occ('title', k) for k in ks)}) + {' + '.join(_occ('body', k) for k in ks)} AS score, {m} AS minimum FROM f" + (f" WHERE {' OR '.join(f'contains(body, {chr(39)}{c}{chr(39)})' for c in cs)}" if cs else "")
    for n, ks, cs, m in TOPICS) + "), ts AS (SELECT doc_id, topic, CAST(score AS BIGINT) AS score FROM t WHERE score >= minimum)"
_UNITS = {"q1": TERMS, "q2": {"tion": 3.5, "ment": 1.8}, "q3": {"able": 3.5}}

ORACLES = {
    "rank_bm25f": f"WITH {_F}, {_bm25(TERMS)} SELECT doc_id, bm25, n_terms FROM s ORDER BY bm25 DESC, doc_id LIMIT 12",
    "bm25f_scores": f"WITH {_F}, {_bm25(TERMS)} SELECT doc_id, bm25, n_terms FROM s",
    "inverted_index_postings": f"WITH {_F}, {_stats(TERMS)} SELECT doc_id, CAST(len_title AS INTEGER) AS len_title, CAST(len_body AS INTEGER) AS len_body, term, CAST(tf_title AS INTEGER) AS tf_title, CAST(tf_body AS INTEGER) AS tf_body FROM p",
    "field_avg_len": f"WITH {_F} SELECT lang, round(avg(length(title)), 4) AS avg_title, round(avg(length(body)), 4) AS avg_body, count(*) AS n FROM f GROUP BY lang",
    "gram_channel": f"WITH {_F}, {_GRAM} SELECT * FROM gram",
    "hybrid_rank": f"WITH {_HYBRID} SELECT doc_id, tier, score, penalty, effective FROM h",
    "review_budget": f"WITH {_HYBRID}, r AS (SELECT *, tier IN ('direct', 'strong_related') AS e, sum(CASE WHEN tier IN ('direct', 'strong_related') THEN 1 ELSE 0 END) OVER (ORDER BY effective DESC, doc_id ROWS UNBOUNDED PRECEDING) AS n FROM h) SELECT doc_id, CAST(CASE WHEN e THEN n END AS BIGINT) AS review_rank, e AND n <= 24 AS in_budget FROM r",
    "manifest_page": f"WITH {_HYBRID}, r AS (SELECT *, row_number() OVER (ORDER BY effective DESC, doc_id) AS pos FROM h) SELECT doc_id, CAST(pos AS INTEGER) AS pos, effective FROM r WHERE pos > 20 AND pos <= 40",
    "topic_rule_score": f"WITH {_TOPIC} SELECT * FROM ts",
    "topic_coverage": f"WITH {_TOPIC}, k AS (SELECT doc_id, count(*) AS k FROM ts GROUP BY doc_id) SELECT lang, count(k) AS assigned, count(*) FILTER (WHERE k IS NULL) AS fallback, count(*) FILTER (WHERE k > 1) AS multi FROM documents LEFT JOIN k USING (doc_id) GROUP BY lang",
    "topic_relative_topk": f"WITH {_TOPIC}, b AS (SELECT *, max(score) OVER (PARTITION BY topic) AS best FROM ts), r AS (SELECT doc_id, topic, score, row_number() OVER (PARTITION BY topic ORDER BY score DESC, doc_id) AS rank FROM b WHERE score >= greatest(8.0, best * 0.4)) SELECT doc_id, topic, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 6",
    "term_overlaps": f"""WITH t AS (SELECT doc_id AS key, {NORM.format('text')} AS t FROM documents), p AS (SELECT key, t, unnest(range(1, length(t) + 1)) AS i FROM t),
h AS (SELECT key, term, i - 1 AS s, i - 1 + length(term) AS e FROM p, (VALUES ('the'), ('ther'), ('there'), ('her'), ('tion'), ('ation')) w(term) WHERE substr(t, i, length(term)) = term)
SELECT key, term, CAST(s AS INTEGER) AS start, CAST(e AS INTEGER) AS "end" FROM h WHERE NOT EXISTS (SELECT 1 FROM h o WHERE o.key = h.key AND o.s <= h.s AND o.e >= h.e AND o.e - o.s > h.e - h.s)""",
    "fusion_argmin": f"WITH {_F}, " + ", ".join(_bm25(w, f"s{n}", f"p{n}") for n, w in _UNITS.items()) + ", u AS (" + " UNION ALL ".join(f"SELECT doc_id, '{n}' AS unit, row_number() OVER (ORDER BY bm25 DESC, doc_id) AS rank, CASE WHEN n_terms > 1 THEN 'direct' ELSE 'strong_related' END AS tier, bm25 FROM s{n}" for n in _UNITS)
    + "), v AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN tier = 'direct' THEN 0 ELSE 1 END, rank, -bm25, unit) AS k, min(rank) OVER (PARTITION BY doc_id) AS best_rank, count(*) OVER (PARTITION BY doc_id) AS n_units FROM u WHERE rank <= 40) SELECT doc_id, CAST(best_rank AS INTEGER) AS best_rank, n_units, unit, tier FROM v WHERE k = 1",
    "two_pool_quota": f"WITH {_HYBRID}, x AS (SELECT h.*, CASE WHEN quality = 1 AND tier = 'direct' THEN 'core' ELSE 'support' END AS pool FROM h JOIN labels USING (doc_id)), r AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY effective DESC, doc_id) AS k FROM x) SELECT doc_id, pool, CAST(k AS INTEGER) AS pool_rank, CASE WHEN k <= CASE WHEN pool = 'core' THEN 6 ELSE 4 END THEN 'selected' ELSE pool || '_limit' END AS outcome FROM r",
    "retrieval_policy": f"WITH {_HYBRID} SELECT tier, CASE WHEN quality IS NULL THEN 'unlabelled' WHEN toxic = 1 THEN 'toxic' WHEN quality = 0 THEN 'low_quality' WHEN penalty > 0 THEN 'excluded_term' ELSE 'eligible' END AS reason, count(*) AS n, max(effective) AS best FROM h LEFT JOIN labels USING (doc_id) GROUP BY 1, 2",
    "recall_gate": f"WITH {_HYBRID} SELECT doc_id, tier FROM h WHERE tier <> 'semantic_lead' OR score >= 12",
    "embedding_topk_cosine": "WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), c AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(e.e, q.e), 4) AS cosine FROM e JOIN e q ON q.vec_id % 20 = 0 AND q.vec_id <> e.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS rank FROM c) SELECT query_id, vec_id, cosine, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3",
}
