"""Queries over the stored search index (RT-01..03, RT-08, RT-09, RT-11)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenquery.operators import retrieval as R
from lumenquery.operators import search as S
from lumenquery.sources.stored import once
from lumenquery.sources.tables import table

from .retrieval_queries import _F, _TOPIC, EXCLUDED, EXPANDED, QUERY, TERMS, TOPICS, _bm25, _fields

LEXICON = sorted({*TERMS, *EXCLUDED, *EXPANDED, *(k for t in TOPICS for k in t[1])})
CONCEPTS, FOCUS = ["tion", "able", "lich"], ["therin", "ation", "eau"]
SIZES = {"title": [2, 3], "body": [2]}
BONUS = {"reviewed": 5.0, "unlabelled": 2.5}


def postings(spark, d):
    lexicon = lambda: spark.createDataFrame([(t,) for t in LEXICON], "term string")
    return once(spark, f"postings {LEXICON}", [f"{d}/documents.parquet"], lambda: S.lexicon_postings(_fields(spark, d), lexicon()).repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id"))


def grams(spark, d):
    return once(spark, f"grams {SIZES}", [f"{d}/documents.parquet"], lambda: S.gram_postings(_fields(spark, d), SIZES).repartitionByRange("gram_id", "doc_id").sortWithinPartitions("gram_id"))


def stats(spark, d):
    return once(spark, "stats", [f"{d}/documents.parquet"], lambda: S.statistics(_fields(spark, d)))


def index_postings(spark, d):
    """RT-01: the stored postings of the lexicon."""
    return postings(spark, d).select("term", "doc_id", "tf_title", "tf_body")


def index_grams(spark, d):
    """RT-01: the stored grams, counted by channel."""
    return grams(spark, d).groupBy("channel", "gram_id").agg(F.count("*").alias("df"))


def _quality(spark, d):
    b = F.when((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), BONUS["reviewed"]).otherwise(0.0)
    lab = table(spark, d, "labels").groupBy("doc_id").agg(F.max(b).alias("b"))
    return table(spark, d, "documents").select("doc_id").join(lab, "doc_id", "left").select("doc_id", F.coalesce("b", F.lit(BONUS["unlabelled"])).alias("bonus"))


def _ranked(spark, d, mode):
    f = _fields(spark, d)
    topics = R.topic_scores(f, spark.createDataFrame(TOPICS, "topic string, keywords array<string>, context_any array<string>, minimum int"))
    return S.ranked(f, S.keyword_scores(postings(spark, d), stats(spark, d), TERMS), S.semantic_scores(grams(spark, d), stats(spark, d), QUERY, 2), topics, _quality(spark, d), CONCEPTS, FOCUS, mode)


def search_keyword(spark, d):
    return _ranked(spark, d, "keyword")


def search_semantic(spark, d):
    return _ranked(spark, d, "semantic")


def search_hybrid(spark, d):
    return _ranked(spark, d, "hybrid")


def search_coverage(spark, d):
    """RT-08: what a search found, by the channels that found it."""
    r = _ranked(spark, d, "hybrid")
    channels = F.concat_ws("+", F.when(F.col("bm25") > 0, "keyword"), F.when(F.col("grams") >= 4, "semantic"), F.when(F.col("topics") > 0, "topic"))
    return r.groupBy(channels.alias("channels")).agg(F.count("*").alias("n"), F.max("score").alias("best"), F.count_if(F.col("quality") == BONUS["reviewed"]).alias("reviewed"))


def search_page(spark, d):
    """RT-08, SRT-05: the manifest's second page with the offset of the next."""
    top = R.page(search_keyword(spark, d), [F.desc("score"), "doc_id"], 10, 10, 60)
    n = F.count("*").over(Window.partitionBy())  # a page
    return top.select("doc_id", "pos", "score", F.when(n == 10, 20).alias("next_offset"))


def lookup_documents(spark, d):
    """RT-09: ids asked for, in their order: found with the sentence that holds the term and its neighbours, rejected or missing."""
    b = table(spark, d, "benchmark").select((F.col("item_id") * 37).alias("doc_id"))
    docs = table(spark, d, "documents").join(table(spark, d, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "doc_id", "left")
    x = S.lookup(b, docs.select("doc_id", "text", "toxic"), F.coalesce("toxic", F.lit(0)) == 0)
    ss = F.filter(F.split(F.lower("text"), r"[.;!?\n]+"), lambda s: F.trim(s) != "")
    x = x.withColumn("ss", F.when(F.col("outcome") == "found", ss)).withColumn("hit", F.get(F.filter(F.sequence(F.lit(0), F.size("ss") - 1), lambda i: F.contains(F.get("ss", i), F.lit("th"))), F.lit(0)))
    window = F.array_join(F.slice("ss", F.greatest(F.lit(1), F.col("hit") - 1), F.least(F.lit(5), F.col("hit") + 3)), "|")
    return x.select("doc_id", "outcome", "hit", F.md5(F.when(F.col("hit").isNotNull(), window).cast("binary")).alias("window"))


def exhaustive_candidates(spark, d):
    """RT-11: every document that the question or any of its concepts alone names."""
    p = postings(spark, d)
    one = p.where(F.col("term").isin(list(TERMS))).select("doc_id", F.lit("question").alias("unit"))
    each = p.where(F.col("term").isin(EXPANDED)).select("doc_id", F.col("term").alias("unit"))
    return one.union(each).distinct().groupBy("doc_id").agg(F.count("*").alias("units"))


def score_breakdown(spark, d):
    """FN-32, PRJ-05: the parts of a score, each rounded, with why a document was retrieved."""
    r = search_hybrid(spark, d)
    why = F.concat_ws(",", *[F.when(F.col(c) > 0, c) for c in ("bm25", "topics", "grams", "focus", "concepts", "quality")])
    return r.select("doc_id", why.alias("why"), F.round(F.col("bm25") + F.col("grams"), 4).alias("text_part"), F.round(F.col("topics") + F.col("focus") + F.col("concepts") + F.col("quality"), 4).alias("rule_part"))


QUERIES = {f.__name__: f for f in (index_postings, index_grams, search_keyword, search_semantic, search_hybrid, search_coverage, search_page, lookup_documents, exhaustive_candidates, score_breakdown)}


def _sql(mode: str) -> str:
    qs = sorted({QUERY[i : i + 2] for i in range(len(QUERY) - 1)})
    glist = "[" + ", ".join(f"'{g}'" for g in qs) + "]"
    hits = lambda c, ts: " + ".join(f"CAST(contains({c}, '{t}') AS INTEGER)" for t in ts)
    use = {"keyword": ("bm25", "topics", "focus"), "semantic": ("grams",), "hybrid": ("bm25", "topics", "focus", "grams")}[mode]
    part = {"bm25": "coalesce(bm25, 0.0)", "topics": "2.0 * coalesce(nt, 0)", "grams": "coalesce(gram_score, 0.0)", "focus": f"33.0 * least(3, {hits('title', FOCUS)}) + 8.0 * least(3, {hits('body', FOCUS)})"}
    named = " OR ".join(x for k, x in (("bm25", "bm25 IS NOT NULL OR nt IS NOT NULL"), ("grams", "gram_score >= 4")) if k in use)
    cols = ", ".join(f"CAST({'round(' + e + ', 4)' if k in use else '0'} AS DOUBLE) AS {k}" for k, e in part.items())
    return f"""{_TOPIC}, {_bm25(TERMS)}, gx AS (SELECT doc_id, title, body, unnest({glist}) AS g FROM f), gd AS (SELECT g, ln(1 + ((SELECT count(*) FROM f) + 1.0) / (count(*) + 1)) AS w FROM gx WHERE contains(title, g) OR contains(body, g) GROUP BY g),
gs AS (SELECT doc_id, round(24 * sum(CASE WHEN contains(title, g) THEN w ELSE 0 END) / greatest(1.0, (SELECT sum(w) FROM gd)) + 14 * sum(CASE WHEN contains(body, g) THEN w ELSE 0 END) / greatest(1.0, (SELECT sum(w) FROM gd)), 4) AS gram_score FROM gx JOIN gd USING (g) WHERE contains(title, g) OR contains(body, g) GROUP BY 1),
tc AS (SELECT doc_id, count(*) AS nt FROM ts GROUP BY 1), lb AS (SELECT doc_id, max(CASE WHEN quality = 1 AND coalesce(toxic, 0) = 0 THEN 5.0 ELSE 0.0 END) AS b FROM labels GROUP BY 1),
rk0 AS (SELECT f.doc_id, {cols}, CAST(4.0 * ({hits('body', CONCEPTS)}) AS DOUBLE) AS concepts, CAST(coalesce(b, 2.5) AS DOUBLE) AS quality FROM f LEFT JOIN s ON s.doc_id = f.doc_id LEFT JOIN gs ON gs.doc_id = f.doc_id LEFT JOIN tc ON tc.doc_id = f.doc_id LEFT JOIN lb ON lb.doc_id = f.doc_id WHERE {named}),
rk AS (SELECT *, round(bm25 + topics + grams + focus + concepts + quality, 4) AS score FROM rk0)"""


_POST = f"{_F}, lx(term) AS (VALUES {', '.join(f"('{t}')" for t in LEXICON)}), px AS (SELECT term, doc_id, (length(title) - length(replace(title, term, ''))) // length(term) AS tf_title, (length(body) - length(replace(body, term, ''))) // length(term) AS tf_body FROM f, lx), pp AS (SELECT * FROM px WHERE tf_title + tf_body > 0)"
_SUB = lambda c, k: f"list_distinct(list_transform(range(1, length({c}) - {k} + 2), lambda i: substr({c}, i, {k})))"

ORACLES = {
    "index_postings": f"WITH {_POST} SELECT term, doc_id, CAST(tf_title AS INTEGER) AS tf_title, CAST(tf_body AS INTEGER) AS tf_body FROM pp",
    "index_grams": f"WITH {_F}, g AS (SELECT 'title' AS channel, unnest({_SUB('title', 2)} || {_SUB('title', 3)}) AS g FROM f UNION ALL SELECT 'body', unnest({_SUB('body', 2)}) FROM f) SELECT channel, substr(md5(g), 1, 12) AS gram_id, count(*) AS df FROM g GROUP BY 1, 2",
    **{f"search_{m}": f"WITH {_sql(m)} SELECT * FROM rk" for m in ("keyword", "semantic", "hybrid")},
    "search_coverage": f"WITH {_sql('hybrid')} SELECT concat_ws('+', CASE WHEN bm25 > 0 THEN 'keyword' END, CASE WHEN grams >= 4 THEN 'semantic' END, CASE WHEN topics > 0 THEN 'topic' END) AS channels, count(*) AS n, max(score) AS best, count(*) FILTER (WHERE quality = 5) AS reviewed FROM rk GROUP BY 1",
    "search_page": f"WITH {_sql('keyword')}, o AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS pos, score FROM rk) SELECT doc_id, CAST(pos AS INTEGER) AS pos, score, CAST(CASE WHEN count(*) OVER () = 10 THEN 20 END AS INTEGER) AS next_offset FROM o WHERE pos > 10 AND pos <= 20",
    "lookup_documents": r"""WITH a AS (SELECT item_id * 37 AS doc_id FROM benchmark), l AS (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY 1), x AS (SELECT a.doc_id, CASE WHEN d.text IS NULL THEN 'missing' WHEN coalesce(toxic, 0) = 0 THEN 'found' ELSE 'rejected' END AS outcome, list_filter(regexp_split_to_array(lower(d.text), '[.;!?\n]+'), lambda s: trim(s) <> '') AS ss FROM a LEFT JOIN documents d ON d.doc_id = a.doc_id LEFT JOIN l ON l.doc_id = a.doc_id),
y AS (SELECT doc_id, outcome, ss, CASE WHEN outcome = 'found' THEN list_filter(range(0, len(ss)), lambda i: contains(ss[i + 1], 'th'))[1] END AS hit FROM x) SELECT doc_id, outcome, CAST(hit AS INTEGER) AS hit, CASE WHEN hit IS NOT NULL THEN md5(array_to_string(ss[CAST(greatest(1, hit - 1) AS BIGINT):CAST(hit + 3 AS BIGINT)], '|')) END AS window FROM y""",
    "exhaustive_candidates": f"WITH {_POST}, u AS (SELECT DISTINCT doc_id, CASE WHEN term IN ({', '.join(repr(t) for t in TERMS)}) THEN 'question' ELSE term END AS unit FROM pp WHERE term IN ({', '.join(repr(t) for t in [*TERMS, *EXPANDED])})) SELECT doc_id, count(*) AS units FROM u GROUP BY 1",
    "score_breakdown": f"WITH {_sql('hybrid')} SELECT doc_id, concat_ws(',', " + ", ".join(f"CASE WHEN {c} > 0 THEN '{c}' END" for c in ("bm25", "topics", "grams", "focus", "concepts", "quality")) + ") AS why, round(bm25 + grams, 4) AS text_part, round(topics + focus + concepts + quality, 4) AS rule_part FROM rk",
}
