"""Secret scans: base patterns, and multipart credentials linked by an interval join.  Only DataFrame functions.

Base spans (assign, access, hex) are always reported.  Weak candidates are
parts that mean little alone: an access identifier, a secret-like string, an
endpoint, each of any length and taken whole.  Parts of one text meet in scopes
of SCOPE code points: two parts belong together when the later one starts within
SCOPE of the earlier one's end.  A weak
candidate is reported only if a part of another role is in its scope, and an
identifier or a secret is among the two: identifier + secret, secret + endpoint
or identifier + endpoint; base spans count as secrets (assign, hex) or
identifiers (access).

Positions come from splitting a text by a pattern: the pieces and the matches
between them add up to the offsets, in code points.  The join runs on (text,
bucket of SCOPE): a part's end looks for starts in its own bucket and the next,
its start for ends in its own and the one before; parts of a kind don't overlap,
so a bucket holds a bounded number of starts and ends, and texts that are copies of each other are joined once.  Whole texts never move.

Defined results: null text counts as empty: no spans, the hash of "".  Repeated
rows give repeated results.  An empty table gives no rows.  Columns beside
those named here are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize

#: How far the end of one part of a credential and the start of the next may be apart, in code points.
SCOPE = 200
#: kind, role, pattern. The groups that count are checked in spans().
BASE = (
    ("assign", "secret", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""),
    ("access", "id", r"AKIA[A-Z0-9]{12,}"),
    ("hex", "secret", r"[0-9a-f]{32,}"),
)
WEAK = (
    ("weak_id", "id", r"(?i:user(?:name)?|login|account|client_?id|access_?key(?:_?id)?)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9_.@-]{3,}"),
    ("weak_secret", "secret", r"(?<![A-Za-z0-9+/])(?=[A-Za-z+/]*+[0-9])[A-Za-z0-9+/]{24,}+={0,2}(?![A-Za-z0-9+/=])"),
    ("weak_endpoint", "endpoint", r"(?:https?|ftp|postgres|mysql|mongodb|redis|amqp)://[A-Za-z0-9._~:/?#@!&*+,;=%-]{4,}"),
)


def spans(text: Column, kind: str, pattern: str) -> Column:
    """array<struct<start, end, kind>> of leftmost non-overlapping matches, in code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    sizes = F.zip_with(F.transform(found, F.length), F.slice(F.transform(pieces, F.length), 1, F.size(found)), lambda m, p: F.struct(p.alias("p"), m.alias("m")))
    kept = F.when(F.size(found) > 0, sizes).otherwise(F.array().cast("array<struct<p:int,m:int>>"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))
    out = F.aggregate(
        kept, zero,
        lambda acc, x: F.struct(
            (acc["at"] + x["p"] + x["m"]).alias("at"),
            F.concat(acc["out"], F.array(F.struct((acc["at"] + x["p"]).alias("start"), (acc["at"] + x["p"] + x["m"]).alias("end")))).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    if kind == "assign":  # the value needs 8 characters or more; a shorter one still takes up its place
        value = F.transform(found, lambda m: F.length(F.regexp_extract(m, r"[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)$", 1)) >= 8)
        out = F.transform(F.filter(F.arrays_zip(out.alias("s"), value.alias("ok")), lambda z: z["ok"]), lambda z: z["s"])
    return F.transform(out, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def digest_text(parts: Column, order: tuple[str, ...]) -> Column:
    """kind:start:end, comma-joined, by start and then as `order` lists the kinds."""
    rank = F.array_position
    keyed = F.transform(parts, lambda s: F.struct(s["start"].alias("start"), rank(F.array(*map(F.lit, order)), s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


KINDS = tuple(k for k, _, _ in BASE + WEAK)
ROLE = {k: r for k, r, _ in BASE + WEAK}


def parts_of(docs: DataFrame) -> DataFrame:
    """doc_id, key of the text, base and weak parts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select("doc_id", text.alias("text"))
    cols = {k: spans(F.col("text"), k, p) for k, _, p in BASE + WEAK}
    d = d.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("key"), *[c.alias(k) for k, c in cols.items()])
    return d.select("doc_id", "key", *[k for k, _, _ in BASE], F.concat(*[F.col(k) for k, _, _ in WEAK]).alias("weak"))


def link(parts: DataFrame) -> DataFrame:
    """The weak parts that have a complementary part in scope: (key, linked)."""
    p = parts.where(F.size("weak") > 0).select("key", F.explode(F.concat("assign", "access", "hex", "weak")).alias("s")).select("key", "s.*").distinct()
    role = F.create_map(*[x for k, r in ROLE.items() for x in (F.lit(k), F.lit(r))])
    p = p.select("*", role[F.col("kind")].alias("role"))
    bucket = lambda c: F.floor(F.col(c) / SCOPE)
    side = lambda ahead, b: F.struct(F.lit(ahead).alias("ahead"), b.alias("near"))
    # ahead: the weak part comes first; what lies over it says nothing new of it
    near = F.array(side(True, bucket("end")), side(True, bucket("end") + 1), side(False, bucket("start") - 1), side(False, bucket("start")))
    weak = p.where(F.col("kind").startswith("weak_")).select("*", F.explode(near).alias("x")).select("key", "start", "end", "kind", "role", "x.*")
    other = p.select("key", F.explode(F.array(side(True, bucket("start")), side(False, bucket("end")))).alias("x"), F.col("start").alias("o_start"), F.col("end").alias("o_end"), F.col("role").alias("o_role")).select("key", "x.*", "o_start", "o_end", "o_role")
    gap = F.when(F.col("ahead"), F.col("o_start") - F.col("end")).otherwise(F.col("start") - F.col("o_end"))
    hit = weak.join(other, ["key", "ahead", "near"]).where((F.col("role") != F.col("o_role")) & gap.between(0, SCOPE))
    return hit.groupBy("key").agg(F.collect_set(F.struct("start", "end", "kind")).alias("linked"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, spans: arrays assign, access, hex, linked of struct<start, end, kind>."""
    parts = materialize(parts_of(docs), "parts")
    none = F.array().cast("array<struct<start:int,end:int,kind:string>>")
    weak = parts.where(F.size("weak") > 0)
    linked = weak.join(materialize(link(parts), "linked"), "key", "left")
    rest = parts.where(F.size("weak") == 0).withColumn("linked", none)
    return linked.select(*rest.columns).union(rest).select("doc_id", "assign", "access", "hex", F.coalesce("linked", none).alias("linked"))


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """docs with every span of `text` (overlapping ones together) replaced by `mark`, and n_chars, if there, set anew."""
    text = F.coalesce(F.col("text"), F.lit(""))
    key, base, weak, linked = (fresh(docs, c) for c in ("key", "base", "weak", "linked"))
    d = docs.select("*", F.sha2(text.cast("binary"), 256).alias(key), *[spans(text, k, p).alias(fresh(docs, k)) for k, _, p in BASE], F.concat(*[spans(text, k, p) for k, _, p in WEAK]).alias(weak))
    d = materialize(d, "found")  # the patterns run once
    parts = d.select(F.col(key).alias("key"), *[F.col(fresh(docs, k)).alias(k) for k, _, _ in BASE], F.col(weak).alias("weak"))
    found = materialize(link(parts), "linked").select(F.col("key").alias(key), F.col("linked").alias(linked))
    none = F.array().cast("array<struct<start:int,end:int,kind:string>>")
    some = d.where(F.size(weak) > 0).join(found, key, "left").withColumn(linked, F.coalesce(linked, none))
    both = d.where(F.size(weak) == 0).withColumn(linked, none).unionByName(some)
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        gap = F.when(s["start"] >= acc["at"], F.concat(F.col("text").substr(acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise("")
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], gap).alias("out"))

    every = F.array_sort(F.concat(*[F.col(fresh(docs, k)) for k, _, _ in BASE], F.col(linked)))
    both = both.withColumn(base, every)
    new = F.aggregate(base, zero, step, lambda acc: F.concat(acc["out"], F.col("text").substr(acc["at"] + 1, F.length("text"))))
    both = both.withColumn("text", F.when(F.size(base) > 0, new).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        both = both.withColumn("n_chars", F.when(F.size(base) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return both.select(*[F.col(f"`{c}`") for c in docs.columns])


def report(found: DataFrame) -> DataFrame:
    base = F.concat("assign", "access", "hex")
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k, _, _ in BASE],
        F.sha2(digest_text(base, KINDS).cast("binary"), 256).alias("base_sha256"),
        digest_text(F.concat(base, "linked"), KINDS).alias("spans"),
        F.size("linked").cast("long").alias("n_linked"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return report(scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
