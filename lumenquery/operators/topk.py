"""Exact top-k search of many questions at once over posting blocks with their greatest impact (RT-01, RT-02, RT-08).

Documents are ordered by language and length and dealt into windows of WINDOW; a block holds a term's postings of one
window: (doc_id, impact), impact a term's BM25F part without its inverse document frequency, as an integer, so scores
are exact sums of longs.  Beside it stands the block's greatest impact, in a column of its own.

A question is a set of rows (question, term, times).  The greatest impacts alone, joined by term, bound each window's
scores from above.  Rounds score windows in descending order of that bound, a few of them at first; the k-th best score so far
bounds what can still be a member, and windows below it are out by proof.  The last round takes all that are left, so the result
is exact.  All questions share each round's scan; nothing is collected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenquery.functions import text as T
from lumenquery.sources.stored import shared_folder

from .retrieval import B, FIELD_WEIGHTS, K1, TF_CAP
from .windows import numbered

WORDS = r"[^\x20\x09-\x0D.,;:!?]+"
WINDOW, SCALE = 64, 1000
#: Windows of a question that each round looks at before the last, and parts that a question's windows are ranked in.
ROUNDS, SALTS = (16, 128), 32
#: Rows of (question, term) that are broadcast at a time.
PART = 200_000


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(WORDS), F.lit(0))


def lengths(docs: DataFrame) -> DataFrame:
    """One row: documents, and the average number of words of a title and of a body."""
    n = {"title": F.size(words(T.first_line(F.col("text")))), "body": F.size(words(F.col("text")))}
    return docs.agg(F.count("*").alias("n"), *[F.round(F.avg(c), 4).alias(f"avg_{f}") for f, c in n.items()])


def postings(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(window, term, doc_id, tf and length of each field); a document's words meet in the partition that its window is dealt to."""
    d = docs.where("doc_id is not null").select("doc_id", "lang", "text", F.coalesce(F.length("text"), F.lit(0)).alias("n"))
    place = numbered(d.groupBy("doc_id").agg(F.min("lang").alias("lang"), F.min("n").alias("n")), ["lang", "n", "doc_id"], "place").select("doc_id", F.floor(F.col("place") / window).alias("window"))
    shared_folder(docs.sparkSession)
    d = d.join(place.checkpoint(), "doc_id")
    d = d.select("window", "doc_id", "text").repartition("window")  # texts move, their words don't
    d = d.select("window", "doc_id", words(T.first_line(F.col("text"))).alias("title"), words(F.col("text")).alias("body"))
    w = d.select("window", "doc_id", F.size("title").alias("len_title"), F.size("body").alias("len_body"), F.explode(F.concat(F.transform("title", lambda x: F.struct(x.alias("term"), F.lit(1).alias("t"), F.lit(0).alias("b"))), F.transform("body", lambda x: F.struct(x.alias("term"), F.lit(0).alias("t"), F.lit(1).alias("b"))))).alias("w"))
    w = w.select("window", "doc_id", "len_title", "len_body", "w.*")
    return w.groupBy("window", "term", "doc_id").agg(F.sum("t").cast("int").alias("tf_title"), F.sum("b").cast("int").alias("tf_body"), F.max("len_title").alias("len_title"), F.max("len_body").alias("len_body"))


def impact(stats: dict) -> Column:
    """A posting's BM25F part without the inverse document frequency, as an integer."""
    score = F.lit(0.0)
    for c, fw in FIELD_WEIGHTS.items():
        tf = F.least(F.col(f"tf_{c}"), F.lit(TF_CAP))
        score = score + fw * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col(f"len_{c}") / F.greatest(F.lit(1.0), F.lit(stats[f"avg_{c}"]))))
    return F.floor(SCALE * score).cast("long")


def blocks(posts: DataFrame, stats: dict) -> DataFrame:
    """(term, window, most, n, docs): posting blocks; a task has all blocks of its windows."""
    p = posts.select("window", "term", F.struct("doc_id", impact(stats).alias("impact")).alias("x"))
    return p.groupBy("window", "term").agg(F.max("x.impact").alias("most"), F.count("*").alias("n"), F.collect_list("x").alias("docs"))


def terms(of: DataFrame) -> DataFrame:
    """(term, df)."""
    return of.groupBy("term").agg(F.sum("n").alias("df"))


def questions(rows: DataFrame, key: str, text: str, most: int = 3) -> DataFrame:
    """(question, term, times): the words of each question, counted up to `most` times."""
    w = rows.select(F.col(key).alias("question"), F.explode(words(F.col(text))).alias("term"))
    return w.groupBy("question", "term").agg(F.least(F.count("*"), F.lit(most)).alias("times"))


def families(known: DataFrame, df: DataFrame, head: int, k: int) -> DataFrame:
    """(cue, term): for each word of `known` (term) the k most frequent index terms that begin as it does, by `head` letters: plain words of more than `head` letters."""
    plain = lambda x: x.where((F.length("term") > head) & F.col("term").rlike("^[a-z]+$")).withColumn("head", F.substring("term", 1, head))
    j = plain(known.select("term").distinct()).withColumnRenamed("term", "cue").join(plain(df), "head").where("term <> cue and df > 1")
    return first_of(j.select("cue", "term", "df"), "cue", [F.desc("df"), "term"], k, "term").select("cue", "term")


def expanded(asked: DataFrame, rules: DataFrame, times: float) -> DataFrame:
    """RT-05: questions with the terms that their words imply, by rules (cue, term); a term counts by the greatest of its weights."""
    more = asked.join(rules.withColumnRenamed("term", "implied"), asked["term"] == F.col("cue")).select("question", F.col("implied").alias("term"), F.lit(times).alias("times"))
    return asked.select("question", "term", F.col("times").cast("double").alias("times")).union(more).groupBy("question", "term").agg(F.max("times").alias("times"))


def weighted(asked: DataFrame, df: DataFrame, n: int) -> DataFrame:
    """(question, term, weight): times the inverse document frequency, as integers."""
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return asked.join(df, "term").select("question", "term", F.floor(SCALE * F.col("times") * idf).cast("long").alias("weight")).where("weight > 0")


def first_of(df: DataFrame, by: str, order: list, k: int, tie: str) -> DataFrame:
    """The k first rows of each group; of each of its salts first, so no task ranks a whole group."""
    salted = Window.partitionBy(by, F.pmod(F.xxhash64(tie), F.lit(SALTS))).orderBy(*order)
    some = df.withColumn("rank", F.row_number().over(salted)).where(F.col("rank") <= k)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= k)


def search(of: DataFrame, asked: DataFrame, k: int, rounds: tuple[int, ...] = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """The k best documents of each question of (question, term, weight), ties to the smaller doc_id: (question, rank, doc_id, score);
    and (question, windows, looked_at): how many windows hold a term of it, and how many were scored.

    Questions are broadcast in parts of some PART rows.  Of the blocks only those of asked terms move, by window and once, in the last round.
    """
    shared_folder(of.sparkSession)
    asked = asked.checkpoint()
    parts = asked.count() // PART + 1
    found = [_search(of, asked.where(F.pmod(F.xxhash64("question"), F.lit(parts)) == i), k, rounds) for i in range(parts)]
    return tuple(reduce(DataFrame.union, x) for x in zip(*found, strict=True))


def _search(of: DataFrame, asked: DataFrame, k: int, rounds: tuple[int, ...]) -> tuple[DataFrame, DataFrame]:
    head = of.select("term", "window", "most").join(F.broadcast(asked), "term")
    bound = head.groupBy("question", "window").agg(F.sum(F.col("weight") * F.col("most")).alias("bound")).checkpoint()
    asked_of = of.select("term", "window", "docs").join(F.broadcast(asked.select("term").distinct()), "term", "left_semi")

    def scored(some: DataFrame, few: bool) -> DataFrame:
        """Every document of these (question, window) that holds a term, with its score; a few windows of each question are broadcast."""
        wanted = some.groupBy("window").agg(F.collect_set("question").alias("wanted"))
        hit = asked_of.join(F.broadcast(wanted) if few else wanted, "window").alias("b").join(F.broadcast(asked).alias("a"), F.expr("a.term = b.term AND array_contains(wanted, question)"))
        hit = hit.select("window", "question", "weight", F.explode("docs").alias("x"))
        return hit.groupBy("window", "question", F.col("x.doc_id").alias("doc_id")).agg(F.sum(F.col("weight") * F.col("x.impact")).alias("score")).drop("window")

    best, done = None, None
    for size in (*rounds, None):
        left = bound
        if done is not None:
            least = best.where(F.col("rank") == k).select("question", F.col("score").alias("least"))
            # a window of an equal bound can hold a tie
            left = left.join(done, ["question", "window"], "left_anti").join(least, "question", "left").where(F.col("least").isNull() | (F.col("bound") >= F.col("least")))
        if size:
            left = first_of(left, "question", [F.desc("bound"), "window"], size, "window")
        left = left.select("question", "window").checkpoint()
        found = first_of(scored(left, bool(size)), "question", [F.desc("score"), "doc_id"], k, "doc_id").select("question", "doc_id", "score")
        # a document is in one window, so none comes twice
        every = found if best is None else found.unionByName(best.select("question", "doc_id", "score"))
        best = first_of(every, "question", [F.desc("score"), "doc_id"], k, "doc_id").select("question", "rank", "doc_id", "score").checkpoint()
        done = left if done is None else done.union(left)
    looked = bound.groupBy("question").agg(F.count("*").alias("windows")).join(done.groupBy("question").agg(F.count("*").alias("looked_at")), "question", "left")
    return best, looked.select("question", "windows", F.coalesce("looked_at", F.lit(0)).alias("looked_at"))
