"""Exact top-k of all benchmark items as questions, over the stored posting blocks (RT-01, RT-02, RT-08)."""

from __future__ import annotations

from lumenquery.operators import topk as K
from lumenquery.sources.stored import once, release
from lumenquery.sources.tables import table

TOP = 10
#: Letters that words of a family share, how many of a family are added, and their weight.
HEAD, FAMILY, IMPLIED = 6, 2, 3.5


def index(spark, d):
    """The stored blocks and their terms, and the statistics that they were made with."""
    docs, paths = table(spark, d, "documents"), [f"{d}/documents.parquet"]
    stats = once(spark, "topk-stats", paths, lambda: K.lengths(docs.where("doc_id is not null"))).first().asDict()
    of = once(spark, f"topk-blocks by window {K.WINDOW}", paths, lambda: K.blocks(K.postings(docs), stats))
    terms = once(spark, "topk-terms", paths, lambda: K.terms(of))
    release(spark)
    return of, terms, stats


def search_topk(spark, d):
    """RT-08: the ten best documents of every benchmark item, by the words that they share."""
    of, terms, stats = index(spark, d)
    asked = K.weighted(K.questions(table(spark, d, "benchmark"), "item_id", "text"), terms, stats["n"])
    return K.search(of, asked, TOP)[0]


def search_expanded(spark, d):
    """RT-05: the same questions with terms of one family added, at IMPLIED times a word's weight."""
    of, terms, stats = index(spark, d)
    asked = K.questions(table(spark, d, "benchmark"), "item_id", "text")
    asked = K.expanded(asked, K.families(asked, terms, HEAD, FAMILY), IMPLIED)
    return K.search(of, K.weighted(asked, terms, stats["n"]), TOP)[0]


QUERIES = {f.__name__: f for f in (search_topk, search_expanded)}

_W = "regexp_extract_all(lower(coalesce({}, '')), '[^\\x20\\x09-\\x0D.,;:!?]+')"
_TITLE = "split_part(text, chr(10), 1)"
_PART = lambda n, w: f"{w} * least(tf_{n}, 8) * 2.35 / (least(tf_{n}, 8) + 1.35 * (1 - 0.72 + 0.72 * len_{n} / greatest(1.0, avg_{n})))"

_HEAD = f"""WITH d AS (SELECT doc_id, {_W.format(_TITLE)} AS tw, {_W.format('text')} AS bw FROM documents), st AS (SELECT count(*) AS n, round(avg(len(tw)), 4) AS avg_title, round(avg(len(bw)), 4) AS avg_body FROM d),
o AS (SELECT doc_id, len(tw) AS len_title, len(bw) AS len_body, unnest(tw) AS term, 1 AS t, 0 AS b FROM d UNION ALL SELECT doc_id, len(tw), len(bw), unnest(bw), 0, 1 FROM d),
p AS (SELECT doc_id, term, any_value(len_title) AS len_title, any_value(len_body) AS len_body, sum(t) AS tf_title, sum(b) AS tf_body FROM o GROUP BY 1, 2),
i AS (SELECT doc_id, term, CAST(floor(1000 * (CAST({_PART('title', 4.0)} AS DOUBLE) + CAST({_PART('body', 1.0)} AS DOUBLE))) AS BIGINT) AS impact FROM p, st), df AS (SELECT term, count(*) AS df FROM p GROUP BY 1),"""
_ASKED = f"""a0 AS (SELECT item_id, term, least(count(*), 3) AS times FROM (SELECT item_id, unnest({_W.format('text')}) AS term FROM benchmark) GROUP BY 1, 2)"""
_REST = """q AS (SELECT item_id, term, CAST(floor(1000 * times * ln(1 + (n - df + 0.5) / (df + 0.5))) AS BIGINT) AS weight FROM a JOIN df USING (term), st),
s AS (SELECT item_id AS question, doc_id, CAST(sum(weight * impact) AS BIGINT) AS score FROM q JOIN i USING (term) WHERE weight > 0 GROUP BY 1, 2)
SELECT question, CAST(row_number() OVER (PARTITION BY question ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s QUALIFY rank <= 10"""
_MORE = f"""fm AS (SELECT cue, t.term FROM (SELECT DISTINCT term AS cue FROM a0 WHERE length(term) > {HEAD} AND regexp_matches(term, '^[a-z]+$')) c JOIN df t ON substr(t.term, 1, {HEAD}) = substr(cue, 1, {HEAD}) AND t.term <> cue AND length(t.term) > {HEAD} AND regexp_matches(t.term, '^[a-z]+$') AND t.df > 1
QUALIFY row_number() OVER (PARTITION BY cue ORDER BY t.df DESC, t.term) <= {FAMILY}),
a AS (SELECT item_id, term, max(times) AS times FROM (SELECT item_id, term, CAST(times AS DOUBLE) AS times FROM a0 UNION ALL SELECT item_id, fm.term, {IMPLIED} FROM a0 JOIN fm ON a0.term = cue) GROUP BY 1, 2)"""

ORACLES = {
    "search_topk": f"{_HEAD} {_ASKED}, a AS (SELECT * FROM a0), {_REST}",
    "search_expanded": f"{_HEAD} {_ASKED}, {_MORE}, {_REST}",
}
