"""Phrase collocation mining with PCY/DHP hashing: bucket counts of the next length in every pass, Apriori before exact counts.

Texts, A-Z lowered, are cut at PIECES into pieces and those into words; phrases are contiguous words of one piece, and
everything is counted per lang.  Pass k reads all texts once and

- counts phrases of k words exactly, if their bucket was full enough in the pass before and both their parts of k - 1
  words are frequent (Apriori, by a bitmap of the frequent parts' buckets); within a task counts are added up over blocks
  of BLOCK words, so a phrase that every text holds moves once a block;
- counts buckets of the phrases of k + 1 words whose two parts of k words passed.

Both bitmaps have 2**BITS bits whatever the data, which bounds what is collected and broadcast.  A bucket holds phrases
of any lang and text that share its hash, so it only lets through too much; what it lets through is counted by the words
themselves, and less than LEAST occurrences go then.  Beyond some 2**BITS * LEAST phrases of a length buckets fill up
and prune less: more is counted, nothing is lost.

A candidate (2 to LONGEST words, LEAST occurrences or more) is cut after each of its words; its score is the least
floor(SCALE * a / (l + r)) over the cuts, a, l and r its own and its parts' counts.  Parts of a candidate are at least as
frequent as it is, so their counts are there.  Candidates inside a longer one with NESTED percent of their occurrences
go.  The best TOP of a lang are found among the best of its salts.

Defined results: null text is empty; null lang is UNKNOWN; rows that share a doc_id count as often as they come; an
empty table gives no rows; other columns, whatever their names, are ignored.  Ties are ordered by count, then by the phrase's UTF-8 bytes.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, mix

PIECES = b".,;:!?\n\x0b\x0c\r"
LEAST, LONGEST, NESTED, TOP, SCALE, UNKNOWN = 30, 4, 80, 2000, 2_000_000, "und"
#: Buckets of a pass, buckets of a slot of them, words that a task holds, parts that a lang's ranking is dealt into.
BITS, SLOT_BITS, BLOCK, SALTS = 27, 16, 1_000_000, 64
MULT = np.uint64(0x9FB21C651E98DF25)

_TO_LINES = bytes(10 if b in PIECES else 32 if b == 9 else b for b in range(256))
#: Stands between pieces; no UTF-8 text has this byte.
EDGE = b"\xff"


def tokens(texts: list[str | None]) -> list[bytes]:
    """Words of the texts, one after the other, with EDGE between pieces."""
    return b"\n".join((t or "").encode("utf-8").lower().translate(_TO_LINES) for t in texts).replace(b"\n", b" " + EDGE + b" ").split(b" ")


class Held:
    """Words of one lang, as numbers."""

    def __init__(self):
        counter = count(1)
        self.number = defaultdict(counter.__next__, {b"": 0, EDGE: 0})
        self.parts, self.size = [], 0

    def add(self, texts: list[str | None]) -> None:
        number = self.number
        ids = np.fromiter((number[w] for w in [*tokens(texts), EDGE] if w), np.int64)
        self.parts.append(ids)
        self.size += len(ids)


def grams(ids: np.ndarray, hashes: np.ndarray, longest: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For 1 to longest words: whether a phrase of that length starts at each place, and its hash."""
    x, inside = hashes[ids], ids != 0
    out = [(inside, mix(x))]
    h, ok = x, inside
    for k in range(1, longest):
        ok = ok[: len(ids) - k] & inside[k:]
        h = h[: len(ids) - k] * MULT + x[k:]
        out.append((ok, mix(h)))
    return out


def bit(bitmap: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    at = hashes >> np.uint64(64 - bits)
    return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def counted(ids: np.ndarray, at: np.ndarray, k: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the phrases of k words at these places: a place of each, and how often it occurs; by the words, not their hashes."""
    key = ids[at]
    for i in range(1, k):
        key = np.unique(key, return_inverse=True)[1] * size + ids[at + i]
    _, first, n = np.unique(key, return_index=True, return_counts=True)
    return at[first], n


PASS = "lang string, phrase binary, hash long, n long, slot int, at binary, c binary"


def _pass(docs: DataFrame, k: int, longest: int, least: int, bits: int, frequent, full) -> DataFrame:
    """One pass over all texts: rows of exact counts, and rows of bucket counts of a slot."""
    names = [c.split()[0] for c in PASS.split(", ")]

    def flush(lang: str, held: Held) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        ids = np.concatenate(held.parts)
        words = list(held.number)
        words = words[:1] + words[2:]  # by number; 0 is no word
        seed = xxh3_64_intdigest(lang.encode("utf-8"))
        hashes = np.fromiter((xxh3_64_intdigest(w, seed) for w in words), np.uint64, len(words))
        found = grams(ids, hashes, min(k + 1, longest))
        ok, h = found[k - 1]
        if k > 1:
            part = bit(frequent.value, found[k - 2][1], bits) & found[k - 2][0]
            ok = ok & part[: len(ok)] & part[1 : len(ok) + 1]
            at = np.flatnonzero(ok)
            hit = at[bit(full.value, h[at], bits)]
            ok = np.zeros(len(ok), bool)
            ok[hit] = True
        first, n = counted(ids, np.flatnonzero(ok), k, len(words))
        columns = [ids[first + i].tolist() for i in range(k)]
        phrases = [b" ".join([words[i] for i in row]) for row in zip(*columns, strict=True)]
        m = len(first)
        none = lambda t: pa.nulls(m, t)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * m, pa.string()), pa.array(phrases, pa.binary()), pa.array(h[first].view(np.int64)), pa.array(n.astype(np.int64)), none(pa.int32()), none(pa.binary()), none(pa.binary())], names)
        if k < longest:
            inside, h = found[k]
            at = np.flatnonzero(inside & ok[: len(inside)] & ok[1 : len(inside) + 1])
            bucket, n = np.unique(h[at] >> np.uint64(64 - bits), return_counts=True)
            n = np.minimum(n, least).astype(np.min_scalar_type(least))  # that many are enough
            slot = bucket >> np.uint64(SLOT_BITS)
            cuts = np.append(np.flatnonzero(np.append(True, slot[1:] != slot[:-1])), len(slot)) if len(slot) else [0]
            rows = [(int(slot[a]), (bucket[a:b] & np.uint64((1 << SLOT_BITS) - 1)).astype(np.uint16).tobytes(), n[a:b].tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            s, at, c = zip(*rows, strict=True) if rows else ((), (), ())
            m = len(rows)
            yield pa.RecordBatch.from_arrays([none(pa.string()), none(pa.binary()), none(pa.int64()), none(pa.int64()), pa.array(s, pa.int32()), pa.array(at, pa.binary()), pa.array(c, pa.binary())], names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Held] = {}
        for batch in (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256)):
            by: dict[str, list] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                held.setdefault(lang, Held()).add(texts)
            if sum(x.size for x in held.values()) >= BLOCK:
                for lang in list(held):
                    yield from flush(lang, held.pop(lang))
        for lang in list(held):
            yield from flush(lang, held.pop(lang))

    return docs.mapInArrow(work, PASS)


def full_buckets(rows: DataFrame, least: int, bits: int) -> np.ndarray:
    """Bits of the buckets with least occurrences or more; 2**bits of them, on the driver."""
    size = 1 << min(SLOT_BITS, bits)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, np.ndarray] = {}
        for batch in batches:
            for slot, at, c in zip(*(batch.column(x).to_pylist() for x in ("slot", "at", "c")), strict=True):
                total = by.setdefault(slot, np.zeros(size, np.uint32))
                at = np.frombuffer(at, np.uint16)
                total[at] = np.minimum(total[at] + np.frombuffer(c, np.min_scalar_type(least)), least)
        if by:
            yield pa.RecordBatch.from_arrays([pa.array(list(by), pa.int32()), pa.array([np.packbits(x >= least, bitorder="little").tobytes() for x in by.values()])], ["slot", "bits"])

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = np.zeros(((1 << bits) // size, size // 8), np.uint8)
    got = rows.where("slot is not null").select("slot", "at", "c").repartition(n, "slot").mapInArrow(add, "slot int, bits binary").toArrow()
    for slot, packed in zip(got.column("slot").to_pylist(), got.column("bits").to_pylist(), strict=True):
        out[slot] = np.frombuffer(packed, np.uint8)
    return out.ravel()


def bitmap(hashes: DataFrame, bits: int) -> np.ndarray:
    """Bits of the buckets of the hashes; 2**bits of them, on the driver."""
    at = F.shiftrightunsigned("hash", 64 - bits)
    words = hashes.groupBy(F.shiftrightunsigned(at, 6).cast("int").alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(hash, {64 - bits}) & 63 as int))")).alias("m")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words.column("w").to_numpy()] = words.column("m").to_numpy()
    return out.view(np.uint8)


def phrase_counts(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, k, f) of all phrases of 1 to longest words with least occurrences or more, and (lang, n): words of each lang."""
    context = docs.sparkSession.sparkContext
    docs = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), "text")
    levels, words, frequent, full = [], None, None, None
    for k in range(1, longest + 1):
        rows = materialize(_pass(docs, k, longest, least, bits, frequent, full), f"pass-{k}")
        exact = rows.where("phrase is not null")
        if k == 1:
            words = exact.groupBy("lang").agg(F.sum("n").alias("n"))
        level = exact.groupBy("lang", "phrase", "hash").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
        level = materialize(level, f"frequent-{k}")
        levels.append(level.select("lang", F.col("phrase").cast("string").alias("phrase"), F.lit(k).alias("k"), "f"))
        if k < longest:
            frequent, full = (context.broadcast(x) for x in (bitmap(level.select("hash"), bits), full_buckets(rows, least, bits)))
    out = levels[0]
    for level in levels[1:]:
        out = out.union(level)
    return out, words


def mine(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, nested: int = NESTED, top: int = TOP, bits: int = BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score."""
    f, words = phrase_counts(docs, least, longest, bits)
    c = f.where("k > 1").withColumnRenamed("f", "a").withColumn("w", F.split("phrase", " "))
    parts = c.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    parts = parts.select("lang", "phrase", "a", "cut", F.array_join(F.expr("slice(w, 1, cut)"), " ").alias("first"), F.array_join(F.expr("slice(w, cut + 1, size(w) - cut)"), " ").alias("rest"))
    of = lambda name, value: f.select("lang", F.col("phrase").alias(name), F.col("f").alias(value))
    parts = parts.join(of("first", "l"), ["lang", "first"]).join(of("rest", "r"), ["lang", "rest"])
    wide = lambda x: x.cast("decimal(20,0)")  # noqa: E731  products of counts may leave a long
    parts = parts.withColumn("score", F.expr(f"(cast({SCALE} as decimal(10,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))"))
    scored = parts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("x")).select("lang", "phrase", "a", "x.l", "x.r", "x.score")
    # every shorter phrase of two words or more inside a candidate, with the greatest count of those that hold it
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("k") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))))
    held = c.where("k > 2").select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = scored.join(held, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * wide(F.col("longer")) < nested * wide(F.col("a")))).drop("longer")
    kept = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    best = [F.desc("score"), F.desc("a"), "phrase"]
    some = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*best))).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).where(F.col("rank") <= top)
    return ranked.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return mine(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, (SELECT unnest([1, 2, 3, 4]) AS k)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL), n AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY 1),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 30),
t AS (SELECT lang, phrase, a, k, unnest(range(1, k)) AS cut, w FROM c),
s AS (SELECT t.lang, t.phrase, t.a, cut, x.f AS l, y.f AS r, (CAST(2000000 AS HUGEINT) * a) // (CAST(x.f AS HUGEINT) + y.f) AS score FROM t
      JOIN f x ON x.lang = t.lang AND x.phrase = array_to_string(t.w[1:cut], ' ') AND x.k = cut JOIN f y ON y.lang = t.lang AND y.phrase = array_to_string(t.w[cut + 1:], ' ') AND y.k = t.k - cut),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
i AS (SELECT lang, a, w, k, unnest(range(2, k)) AS m FROM c), j AS (SELECT lang, a, w, m, unnest(range(1, k - m + 2)) AS o FROM i),
h AS (SELECT lang, array_to_string(w[o:o + m - 1], ' ') AS phrase, max(a) AS longer FROM j GROUP BY 1, 2)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM b JOIN n ON n.lang = b.lang LEFT JOIN h ON h.lang = b.lang AND h.phrase = b.phrase WHERE longer IS NULL OR CAST(100 AS HUGEINT) * longer < CAST(80 AS HUGEINT) * a
QUALIFY rank <= 2000
"""
