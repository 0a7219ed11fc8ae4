"""An index that grows (RT-01, ST-01): segments by batch, tombstones, merges of equal tiers, freshness by the input's fingerprint.

The index is two tables of a Journal, so each batch is seen whole or not at all and the next application reads on.
A segment is what one transaction added:

    docs      (doc_id, version, digest, words, deleted)   a row for each document of the batch; deleted is a tombstone
    postings  (term, doc_id, version, tf)                 what the batch's documents hold

Of a document the row of the greatest version counts; postings count if their version is that one.  Reading merges the
segments by one join on doc_id; merge() keeps their number logarithmic: FAN segments of a tier become one of the next,
without rows that later ones have replaced.  A tombstone goes when no older segment is left that it could hide rows of.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenquery.sources.journal import Journal
from lumenquery.sources.stored import fingerprint

from .topk import words

FAN = 4
DOCS = "doc_id long, version long, digest string, words int, deleted boolean"
POSTINGS = "term string, doc_id long, version long, tf int"


class GrowingIndex:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.journal = spark, Journal(spark, folder)
        self.journal.recover()

    def current(self, version: int | None = None) -> DataFrame:
        """(doc_id, version, digest, words): the documents that stand."""
        d = self.journal.read("docs", version, DOCS).groupBy("doc_id").agg(F.max_by(F.struct("version", "digest", "words", "deleted"), "version").alias("r"))
        return d.select("doc_id", "r.*").where("not deleted").drop("deleted")

    def postings(self, version: int | None = None) -> DataFrame:
        """(term, doc_id, tf) of the documents that stand."""
        live = self.current(version).select("doc_id", "version")
        return self.journal.read("postings", version, POSTINGS).join(live, ["doc_id", "version"]).select("term", "doc_id", "tf")

    def apply(self, changed: DataFrame, deleted: DataFrame, note: dict | None = None, base: int | None = None) -> int:
        """Add or replace the documents (doc_id, text) of `changed`, and take out the ids (doc_id) of `deleted`, in one transaction; then merge."""
        base = self.journal.version() if base is None else base
        v = F.lit(base + 1).cast("long").alias("version")
        w = changed.select("doc_id", v, digest().alias("digest"), words(F.col("text")).alias("w"))
        docs = w.select("doc_id", "version", "digest", F.size("w").alias("words"), F.lit(False).alias("deleted"))
        gone = deleted.select("doc_id", v, F.lit(None).cast("string").alias("digest"), F.lit(0).alias("words"), F.lit(True).alias("deleted"))
        posts = w.select("doc_id", "version", F.explode("w").alias("term")).groupBy("term", "doc_id", "version").agg(F.count("*").cast("int").alias("tf"))
        self.journal.commit({"docs": docs.union(gone), "postings": posts}, base, note={"tier": 0, **(note or {})})
        self.merge()
        return self.journal.version()

    def sync(self, path: str) -> dict[str, int] | None:
        """Follow the documents at a path: their new, changed and removed rows as a batch.  None if its files are those of the last time."""
        base = self.journal.version()
        now = fingerprint(self.spark, path)
        last = [e["note"]["input"] for _, e in self.journal.entries() if "input" in e["note"]]
        if last and last[-1] == now:
            return None
        docs = self.spark.read.parquet(path).where("doc_id is not null").groupBy("doc_id").agg(F.min("text").alias("text"))
        have = self.current(base).select("doc_id", F.col("digest").alias("old"))
        j = docs.withColumn("new", digest()).join(have, "doc_id", "full").cache()
        try:
            kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
            counts = {r.kind: r.n for r in j.groupBy(kind.alias("kind")).agg(F.count("*").alias("n")).where("kind is not null").collect()}
            self.apply(j.where(kind.isin("added", "changed")).select("doc_id", "text"), j.where(kind == "removed").select("doc_id"), {"input": now}, base)
        finally:
            j.unpersist()
        return {k: counts.get(k, 0) for k in ("added", "changed", "removed")}

    def segments(self) -> dict[int, int]:
        """Tier by the number of the segment's transaction."""
        parts = self.journal.parts("docs")
        return {n: e["note"].get("tier", 0) for n, e in self.journal.entries() if n in parts}

    def merge(self) -> None:
        """Make one segment of each FAN neighbours of a tier, as long as there are any.

        Neighbours, so that the segments before them are all older and those behind are all newer.
        """
        while True:
            tiers = self.segments()
            order = sorted(tiers, key=lambda n: self._span(n))
            found = next((order[i : i + FAN] for i in range(len(order) - FAN + 1) if len({tiers[n] for n in order[i : i + FAN]}) == 1), None)
            if not found:
                return
            base, tier = self.journal.version(), tiers[found[0]] + 1
            paths = {t: [f"{self.journal.folder}/{p}" for n, p in self.journal.parts(t).items() if n in found] for t in ("docs", "postings")}
            docs = self.spark.read.schema(DOCS).parquet(*paths["docs"])
            docs = docs.groupBy("doc_id").agg(F.max_by(F.struct("version", "digest", "words", "deleted"), "version").alias("r")).select("doc_id", "r.*")
            posts = self.spark.read.schema(POSTINGS).parquet(*paths["postings"]).join(docs.where("not deleted").select("doc_id", "version"), ["doc_id", "version"]).select("term", "doc_id", "version", "tf")
            if found[0] == order[0]:
                docs = docs.where("not deleted")
            self.journal.commit({"docs": docs, "postings": posts}, base, removes={"docs": found, "postings": found}, note={"tier": tier, "span": self._span(found[0])})

    def _span(self, n: int) -> int:
        """The first of the transactions whose rows a segment holds."""
        return dict(self.journal.entries())[n]["note"].get("span", n)


def digest():
    return F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
