"""Scalar and text operators over documents, pages, events (FN-*, FLT-01/02/03/08, PRJ-*, SRC-04, SNK-04)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenquery.functions import text as T
from lumenquery.sources.tables import table

NORM = r"array_to_string(regexp_extract_all(lower({0}), '([\x{{4e00}}-\x{{9fff}}]+|[a-z0-9]+)'), '')"
TITLE = "split_part(text, chr(10), 1)"
GRAMS = "list_sort(list_distinct(list_transform(range(1, length({0}) - {1} + 2), lambda i: substr({0}, i, {1}))))"
#: Rules are data: dictionary, signals, topics over the synthetic vocabulary.
DICTIONARY = {"the": "THE", "ther": "THER", "and": "&", "ing": "in'", "tion": "t~n"}
URL_POLICY = {"scheme": "https", "suffixes": ["example.org", "example.com"]}


def docs(spark, d):
    return table(spark, d, "documents")


def norm_text(spark, d):
    n = T.norm(F.col("text"))
    return docs(spark, d).select("doc_id", F.length(n).alias("n_norm"), F.md5(n.cast("binary")).alias("norm_md5"))


def norm_variants(spark, d):
    return docs(spark, d).select("doc_id", F.md5(T.norm_spaces(F.col("text")).cast("binary")).alias("spaced"), F.md5(T.norm_compact(F.col("text")).cast("binary")).alias("compact"))


def char_ngrams_distinct(spark, d):
    g = T.grams(T.norm(F.col("text")), 3)
    return docs(spark, d).select("doc_id", g.alias("g")).select("doc_id", F.size("g").alias("n_grams"), F.md5(F.array_join("g", ",").cast("binary")).alias("grams_md5"))


def gram_df(spark, d):
    """AGG-15: document frequency of grams of whole texts, and their weight; counted first, then hashed."""
    x = docs(spark, d)
    n = F.broadcast(x.agg(F.count("*").alias("n")))
    g = x.select(F.explode(T.grams(T.norm(F.col("text")), 2)).alias("gram")).groupBy("gram").agg(F.count("*").alias("df"))
    return g.join(n).select(T.gram_hash(F.col("gram")).alias("gram_id"), "df", F.round(F.log(1 + (F.col("n") + 1) / (F.col("df") + 1)), 4).alias("weight"))


def jaccard_items(spark, d):
    """SET-06 as a join on shared words: benchmark items and documents, whole texts, words of five letters or more."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-z]{5,})"), F.lit(1)))
    b = table(spark, d, "benchmark").select("item_id", words(F.col("text")).alias("ga"))
    x = docs(spark, d).select("doc_id", words(F.col("text")).alias("gb"))
    left, right = b.select("item_id", F.size("ga").alias("na"), F.explode("ga").alias("g")), x.select("doc_id", F.size("gb").alias("nb"), F.explode("gb").alias("g"))
    i = right.join(left, "g").groupBy("item_id", "doc_id").agg(F.count("*").alias("shared"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    return i.select("item_id", "doc_id", F.round(F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared")), 4).alias("jaccard")).where("jaccard >= 0.02")


def text_match_score(spark, d):
    """SET-07: how much of a question's grams each title covers."""
    needle = F.lit("thereand")
    g = T.grams(needle, 2)
    t = T.norm(F.col("text"))
    return docs(spark, d).select("doc_id", F.round(T.coverage(needle, t, g, T.grams(t, 2)), 4).alias("match_score"))


def letter_ratio(spark, d):
    return docs(spark, d).select("doc_id", F.round(T.class_ratio(F.col("text"), "a-z"), 4).alias("ratio"))


def title_views(spark, d):
    """FN-08, FN-25."""
    t = T.first_line(F.col("text"))
    return docs(spark, d).select("doc_id", T.clean_title(t).alias("clean"), T.shorten(t, 24).alias("short"))


def url_redact(spark, d):
    p = table(spark, d, "pages")
    r = T.redact_urls(F.col("html"))
    return p.select("page_id", F.md5(r.cast("binary")).alias("redacted_md5"), T.occurrences(r, "[url]").alias("n_urls"))


def dictionary_canonicalize(spark, d):
    return docs(spark, d).select("doc_id", F.md5(T.replace_longest_first(F.col("text"), DICTIONARY).cast("binary")).alias("canonical_md5"))


def occurrence_count_capped(spark, d):
    return docs(spark, d).select("doc_id", *[T.occurrences(F.col("text"), w, 8).alias(f"n_{w}") for w in ("the", "de", "ing")])


def clock_format(spark, d):
    s = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    return table(spark, d, "events").select("event_id", T.clock(s).alias("mm_ss"), T.srt_clock(s.cast("long") * 1000 + F.col("event_id") % 1000).alias("srt"))


def json_prop(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, d, "events").groupBy("event_type", k.alias("k")).agg(F.count("*").alias("n"))


def stable_ids(spark, d):
    """FN-23/24, SNK-04: digest of a row as canonical JSON, and a short id."""
    x = docs(spark, d).select("doc_id", "lang", "source")
    row = F.concat(F.lit('{"doc_id":'), F.col("doc_id").cast("string"), F.lit(',"lang":"'), F.col("lang"), F.lit('","source":"'), F.col("source"), F.lit('"}'))
    return x.select("doc_id", F.sha2(row.cast("binary"), 256).alias("row_sha256"), T.short_id("doc-", row).alias("short_id"))


#: Levels of 100 blocks each below a source's own digest: 100 million ids are 100 blocks of the last level.
LEVELS = 4


def table_digest(spark, d):
    """AGG-17: one digest a source, which depends on order: a SHA-256 over the digests of its blocks in order, LEVELS deep, the lowest over rows.

    A block holds 100 ids or 100 blocks of the level below, so no source is gathered whole.
    """
    part = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    row = F.concat_ws(":", part(F.col("doc_id")), part(F.md5(F.col("text").cast("binary"))))
    x = docs(spark, d).select("source", F.col("doc_id").alias("place"), F.sha2(row.cast("binary"), 256).alias("h"), F.lit(1).cast("long").alias("n"))
    chain = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.isnull("place"), "place", "h"))), lambda r: r["h"]), "").cast("binary"), 256)
    for _ in range(LEVELS):
        x = x.groupBy("source", F.expr("place div 100").alias("block")).agg(chain.alias("h"), F.sum("n").alias("n")).withColumnRenamed("block", "place")
    return x.groupBy("source").agg(chain.alias("digest"), F.sum("n").alias("n"))


def _table_digest_sql():
    level = "SELECT source, place // 100 AS place, sha256(string_agg(h, '' ORDER BY place NULLS LAST, h)) AS h, CAST(sum(n) AS BIGINT) AS n FROM l{} GROUP BY source, place // 100"
    levels = ", ".join(f"l{i + 1} AS ({level.format(i)})" for i in range(LEVELS))
    rows = "SELECT source, doc_id AS place, sha256(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(md5(text), '')) AS h, 1 AS n FROM documents"
    return f"WITH l0 AS ({rows}), {levels} SELECT source, sha256(string_agg(h, '' ORDER BY place NULLS LAST, h)) AS digest, CAST(sum(n) AS BIGINT) AS n FROM l{LEVELS} GROUP BY source"


def classify_documents(spark, d):
    """FLT-03: signals, then decisions by priority, labels as an array."""
    t = F.col("text")
    x = docs(spark, d).select(
        "doc_id", t.rlike(r"[$&#*%]{3}").alias("symbols"), t.rlike(r" \| ").alias("tabular"), t.rlike(r"[A-Z]{4,}!!").alias("shouting"), t.rlike(r"@[a-z0-9.]+").alias("contact"), (F.length(t) < 200).alias("brief"),
    )
    decision = F.when(F.col("symbols") & F.col("contact"), "review").when(F.col("symbols") | F.col("shouting"), "exclude").when(F.col("tabular"), "table").when(F.col("brief"), "review_short").otherwise("keep")
    names = ["symbols", "tabular", "shouting", "contact", "brief"]
    return x.select("doc_id", decision.alias("decision"), F.array_join(F.array_compact(F.array(*[F.when(F.col(c), c) for c in names])), ";").alias("labels"))


def classify_override(spark, d):
    """FLT-03: a manual decision wins over the automatic one; drift is kept as data."""
    auto = classify_documents(spark, d)
    manual = table(spark, d, "labels").select("doc_id", F.when(F.col("toxic") == 1, "exclude").when(F.col("quality") == 0, "review").alias("manual")).where("manual is not null")
    j = auto.join(manual, "doc_id", "left")
    return j.select("doc_id", F.coalesce("manual", "decision").alias("final"), (F.col("manual").isNotNull() & (F.col("manual") != F.col("decision"))).alias("drift"))


def quality_gates(spark, d):
    """FN-12: five predicates into an array of issues."""
    t, n = F.col("text"), F.size(F.regexp_extract_all("text", F.lit(r"[^ \n]+"), F.lit(0)))
    issues = F.array_compact(F.array(
        F.when(F.length(t) < 100, "short"), F.when(n < 20, "few_words"), F.when(F.length(t) / F.greatest(n, F.lit(1)) > 9, "long_words"),
        F.when(~F.col("lang").isin("en", "fr", "de"), "lang"), F.when(T.class_ratio(t, "a-zA-Z") < 0.7, "letters"),
    ))
    return docs(spark, d).select("doc_id", F.array_join(issues, ",").alias("issues"), (F.size(issues) == 0).alias("passed"))


def url_policy(spark, d):
    """FLT-08, PRJ-01/02, FN-34: parts of a URL by pattern, host suffixes, reasons."""
    host = F.regexp_extract("url", r"^[a-z]+://([^/:]+)", 1)
    ok_host = F.lit(False)
    for s in URL_POLICY["suffixes"]:
        ok_host = ok_host | (host == s) | host.endswith("." + s)
    reason = F.when(~F.startswith("url", F.lit("https://")), "scheme").when(F.contains("url", F.lit("@")), "userinfo").when(~ok_host, "host").when(F.length("url") > 200, "length").otherwise("ok")
    ident = F.coalesce(F.nullif(F.regexp_extract("url", r"/(\d+)$", 1), F.lit("")), F.concat(F.lit("page-"), F.col("page_id").cast("string")))
    return table(spark, d, "pages").select("page_id", host.alias("host"), reason.alias("verdict"), ident.alias("ident"))


def row_integrity(spark, d):
    """FLT-10/13, MSC-10: what pages break, as rows: their own form, and addresses that come twice."""
    p = table(spark, d, "pages")
    dup = p.groupBy("url").agg(F.count("*").alias("c"), F.collect_list("page_id").alias("ids")).where("c > 1").select(F.explode("ids").alias("page_id"), F.lit("duplicate_url").alias("violation"))
    checks = {
        "not_https": ~F.startswith("url", F.lit("https://")), "has_query": F.contains("url", F.lit("?")), "has_fragment": F.contains("url", F.lit("#")), "no_title": ~F.contains("html", F.lit("<title>")), "upper_host": F.lower("url") != F.col("url"),
        "blank": F.trim("html") == "", "no_language": ~F.col("html").rlike('<html lang="[a-z]{2}">'), "symbols_in_title": F.regexp_extract("html", "<title>([^<]*)</title>", 1).rlike("[#$%*]{2}"), "path_without_number": ~F.col("url").rlike(r"/[0-9]+"),
    }
    each = p.select("page_id", F.explode(F.array_compact(F.array(*[F.when(c, k) for k, c in checks.items()]))).alias("violation"))
    return dup.union(each)


def status_filter(spark, d):
    """FLT-01/06: status, prefix and id-list predicates reach the scan."""
    return docs(spark, d).where(F.col("lang").isin("en", "de") & F.startswith("source", F.lit("src1")) & ~F.col("doc_id").isin(3, 5, 8)).select("doc_id", "lang", "source", "n_chars")


def alias_match(spark, d):
    """JON-23: a term matches a concept if either contains the other."""
    c = spark.createDataFrame([("greet", "the"), ("join", "and"), ("end", "ation")], "concept string, term string")
    s = docs(spark, d).groupBy(F.lower(F.element_at(F.split("text", " "), 1)).alias("word")).agg(F.count("*").alias("n")).where("length(word) >= 2")
    return s.join(F.broadcast(c), F.contains("word", "term") | F.contains("term", "word")).select("concept", "word", "n")


QUERIES = {f.__name__: f for f in (norm_text, norm_variants, char_ngrams_distinct, gram_df, jaccard_items, text_match_score, letter_ratio, title_views, url_redact, dictionary_canonicalize, occurrence_count_capped, clock_format, json_prop, stable_ids, table_digest, classify_documents, classify_override, quality_gates, url_policy, row_integrity, status_filter, alias_match)}

_T = NORM.format(TITLE)
_CLASSIFY = """SELECT doc_id, CASE WHEN symbols AND contact THEN 'review' WHEN symbols OR shouting THEN 'exclude' WHEN tabular THEN 'table' WHEN brief THEN 'review_short' ELSE 'keep' END AS decision,
concat_ws(';', CASE WHEN symbols THEN 'symbols' END, CASE WHEN tabular THEN 'tabular' END, CASE WHEN shouting THEN 'shouting' END, CASE WHEN contact THEN 'contact' END, CASE WHEN brief THEN 'brief' END) AS labels
FROM (SELECT doc_id, regexp_matches(text, '[$&#*%]{3}') AS symbols, contains(text, ' | ') AS tabular, regexp_matches(text, '[A-Z]{4,}!!') AS shouting, regexp_matches(text, '@[a-z0-9.]+') AS contact, length(text) < 200 AS brief FROM documents)"""
_REPLACED = "text"
for _k in sorted(DICTIONARY, key=lambda k: (-len(k), k)):
    _REPLACED = f"replace({_REPLACED}, '{_k}', '{DICTIONARY[_k].replace(chr(39), chr(39) * 2)}')"

ORACLES = {
    "norm_text": f"SELECT doc_id, CAST(length({NORM.format('text')}) AS INTEGER) AS n_norm, md5({NORM.format('text')}) AS norm_md5 FROM documents",
    "norm_variants": r"""SELECT doc_id, md5(lower(trim(regexp_replace(text, '\s+', ' ', 'g')))) AS spaced, md5(lower(regexp_replace(text, '[\s.,;:!?()|"''-]+', '', 'g'))) AS compact FROM documents""",
    "char_ngrams_distinct": f"WITH t AS (SELECT doc_id, {NORM.format('text')} AS t FROM documents), g AS (SELECT doc_id, {GRAMS.format('t', 3)} AS g FROM t) SELECT doc_id, CAST(len(g) AS INTEGER) AS n_grams, md5(array_to_string(g, ',')) AS grams_md5 FROM g",
    "gram_df": f"WITH t AS (SELECT doc_id, {NORM.format('text')} AS t FROM documents), g AS (SELECT unnest({GRAMS.format('t', 2)}) AS gram FROM t) SELECT substr(md5(gram), 1, 12) AS gram_id, count(*) AS df, round(ln(1 + ((SELECT count(*) FROM documents) + 1.0) / (count(*) + 1)), 4) AS weight FROM g GROUP BY 1",
    "jaccard_items": """WITH a AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '([a-z]{5,})', 1)) AS ga FROM benchmark), b AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '([a-z]{5,})', 1)) AS gb FROM documents),
i AS (SELECT item_id, doc_id, count(*) AS i FROM (SELECT item_id, unnest(ga) AS g FROM a) JOIN (SELECT doc_id, unnest(gb) AS g FROM b) USING (g) GROUP BY 1, 2)
SELECT item_id, doc_id, round(i / (len(ga) + len(gb) - i), 4) AS jaccard FROM i JOIN a USING (item_id) JOIN b USING (doc_id) WHERE round(i / (len(ga) + len(gb) - i), 4) >= 0.02""",
    "text_match_score": f"""WITH t AS (SELECT doc_id, {NORM.format('text')} AS t FROM documents), g AS (SELECT doc_id, t, t AS h FROM t),
x AS (SELECT doc_id, t, {GRAMS.format('h', 2)} AS hg, (SELECT {GRAMS.format('n', 2)} FROM (SELECT 'thereand' AS n)) AS ng FROM g)
SELECT doc_id, round(CASE WHEN contains(t, 'thereand') THEN 1.0 ELSE len(list_intersect(ng, hg)) / greatest(1, len(ng)) END, 4) AS match_score FROM x""",
    "letter_ratio": r"SELECT doc_id, round(CASE WHEN length(regexp_replace(text, '\s', '', 'g')) = 0 THEN 0.0 ELSE length(regexp_replace(text, '[^a-z]', '', 'g')) / length(regexp_replace(text, '\s', '', 'g')) END, 4) AS ratio FROM documents",
    "title_views": f"SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace({TITLE}, '[#@][^ ]*', ' ', 'g'), '^[0-9]+ *', ''), ' +', ' ', 'g')) AS clean, CASE WHEN length({TITLE}) > 24 THEN substr({TITLE}, 1, 23) || '…' ELSE {TITLE} END AS short FROM documents",
    "url_redact": """WITH r AS (SELECT page_id, regexp_replace(html, 'https?://[^ "''<>)]+', '[url]', 'g') AS r FROM pages) SELECT page_id, md5(r) AS redacted_md5, CAST((length(r) - length(replace(r, '[url]', ''))) / 5 AS INTEGER) AS n_urls FROM r""",
    "dictionary_canonicalize": f"SELECT doc_id, md5({_REPLACED}) AS canonical_md5 FROM documents",
    "occurrence_count_capped": "SELECT doc_id, " + ", ".join(f"CAST(least(8, (length(text) - length(replace(text, '{w}', ''))) // {len(w)}) AS INTEGER) AS n_{w}" for w in ("the", "de", "ing")) + " FROM documents",
    "clock_format": """WITH s AS (SELECT event_id, CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS BIGINT) AS s FROM events)
SELECT event_id, printf('%02d:%02d', s // 60, s % 60) AS mm_ss, printf('%02d:%02d:%02d,%03d', s // 3600, s % 3600 // 60, s % 60, event_id % 1000) AS srt FROM s""",
    "json_prop": "SELECT event_type, CAST(props->>'k' AS INTEGER) AS k, count(*) AS n FROM events GROUP BY 1, 2",
    "stable_ids": """WITH r AS (SELECT doc_id, '{"doc_id":' || doc_id || ',"lang":"' || lang || '","source":"' || source || '"}' AS r FROM documents) SELECT doc_id, sha256(r) AS row_sha256, 'doc-' || substr(sha256(r), 1, 16) AS short_id FROM r""",
    "table_digest": _table_digest_sql(),
    "classify_documents": _CLASSIFY,
    "classify_override": f"""WITH a AS ({_CLASSIFY}), m AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'exclude' WHEN quality = 0 THEN 'review' END AS manual FROM labels WHERE toxic = 1 OR quality = 0)
SELECT a.doc_id, coalesce(manual, decision) AS final, manual IS NOT NULL AND manual <> decision AS drift FROM a LEFT JOIN m USING (doc_id)""",
    "quality_gates": r"""WITH x AS (SELECT doc_id, text, lang, len(regexp_extract_all(text, '[^ \n]+')) AS n, length(regexp_replace(text, '\s', '', 'g')) AS solid, length(regexp_replace(text, '[^a-zA-Z]', '', 'g')) AS letters FROM documents),
i AS (SELECT doc_id, concat_ws(',', CASE WHEN length(text) < 100 THEN 'short' END, CASE WHEN n < 20 THEN 'few_words' END, CASE WHEN length(text) / greatest(n, 1) > 9 THEN 'long_words' END, CASE WHEN lang NOT IN ('en', 'fr', 'de') THEN 'lang' END, CASE WHEN CASE WHEN solid = 0 THEN 0.0 ELSE letters / solid END < 0.7 THEN 'letters' END) AS issues FROM x)
SELECT doc_id, issues, issues = '' AS passed FROM i""",
    "url_policy": r"""WITH h AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/:]+)', 1) AS host FROM pages)
SELECT page_id, host, CASE WHEN NOT starts_with(url, 'https://') THEN 'scheme' WHEN contains(url, '@') THEN 'userinfo' WHEN NOT (host IN ('example.org', 'example.com') OR suffix(host, '.example.org') OR suffix(host, '.example.com')) THEN 'host' WHEN length(url) > 200 THEN 'length' ELSE 'ok' END AS verdict,
coalesce(nullif(regexp_extract(url, '/(\d+)$', 1), ''), 'page-' || page_id) AS ident FROM h""",
    "row_integrity": """SELECT page_id, 'duplicate_url' AS violation FROM pages WHERE url IN (SELECT url FROM pages GROUP BY url HAVING count(*) > 1)
UNION ALL SELECT page_id, 'not_https' FROM pages WHERE NOT starts_with(url, 'https://') UNION ALL SELECT page_id, 'has_query' FROM pages WHERE contains(url, '?') UNION ALL SELECT page_id, 'has_fragment' FROM pages WHERE contains(url, '#')
UNION ALL SELECT page_id, 'no_title' FROM pages WHERE NOT contains(html, '<title>') UNION ALL SELECT page_id, 'upper_host' FROM pages WHERE lower(url) <> url UNION ALL SELECT page_id, 'blank' FROM pages WHERE trim(html) = ''
UNION ALL SELECT page_id, 'no_language' FROM pages WHERE NOT regexp_matches(html, '<html lang="[a-z]{2}">') UNION ALL SELECT page_id, 'symbols_in_title' FROM pages WHERE regexp_matches(regexp_extract(html, '<title>([^<]*)</title>', 1), '[#$%*]{2}') UNION ALL SELECT page_id, 'path_without_number' FROM pages WHERE NOT regexp_matches(url, '/[0-9]+')""",
    "status_filter": "SELECT doc_id, lang, source, n_chars FROM documents WHERE lang IN ('en', 'de') AND starts_with(source, 'src1') AND doc_id NOT IN (3, 5, 8)",
    "alias_match": """WITH c(concept, term) AS (VALUES ('greet', 'the'), ('join', 'and'), ('end', 'ation')), s AS (SELECT lower(split_part(text, ' ', 1)) AS word, count(*) AS n FROM documents GROUP BY 1 HAVING length(lower(split_part(text, ' ', 1))) >= 2)
SELECT concept, word, n FROM s JOIN c ON contains(word, term) OR contains(term, word)""",
}
