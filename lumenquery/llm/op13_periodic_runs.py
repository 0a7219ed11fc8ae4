"""Periodic run detection: repeated k-gram masking, then Main-Lorentz on what is left.

A run is a stretch of words with smallest period q (words q apart are equal) and
length >= max(LEAST, TIMES * q) that no neighbouring word extends keeping period
q.  Its first length - q words are equal to its last length - q ones, and these
two overlaps cover it.  The overlap is at least LEAST - LEAST // TIMES words
long, so every word of a run lies in a k-gram of that length that occurs
at least twice in the document.  Words outside such k-grams are masked; what is
left falls into segments, and a run lies in one segment with all of its length.
The k-grams are told apart by 64-bit hashes: two that clash leave more words, never fewer.

On a segment Main-Lorentz halves: the runs that cross the middle of a part come
from longest common prefixes and suffixes with both halves (Z functions, linear
in the part), the others from the halves.  A run that its part cuts off is found
whole in the part that it crosses the middle of.

A document is one row and one task's work, n log n in its words whatever they
are; nothing is shuffled.

Defined results: null or blank text has no words and no runs; a null doc_id is
an ordinary document, whose words are never rewritten by perturbed(); rows that
share a doc_id are documents of their own; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import window_hashes

LEAST, TIMES = 24, 3


def ids_of(words: list[bytes]) -> list[int]:
    """Equal words, equal numbers."""
    known: dict[bytes, int] = {}
    return [known.setdefault(w, len(known)) for w in words]


def segments(ids: list[int], least: int = LEAST, times: int = TIMES) -> list[tuple[int, int]]:
    """Stretches (start, end) of words inside k-grams that occur twice or more, k the least overlap of a run with itself; those that could hold a run."""
    k = least - least // times
    if len(ids) < least:
        return []
    grams = window_hashes(np.array(ids, np.uint64), k)
    _, group, count = np.unique(grams, return_inverse=True, return_counts=True)
    edge = np.zeros(len(ids) + 1, np.int64)
    hit = np.flatnonzero(count[group] > 1)
    edge[hit] += 1
    edge[hit + k] -= 1
    inside = np.concatenate([[0], np.cumsum(edge[:-1]) > 0, [0]]).astype(np.int8)
    step = np.diff(inside)
    return [(a, b) for a, b in zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), strict=True) if b - a >= least]


def z_values(s: list[int]) -> list[int]:
    """Of each place, how many words from there on are as from the start."""
    n = len(s)
    z = [0] * n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    if n:
        z[0] = n
    return z


def crossing(s: list[int], a: int, m: int, b: int, least: int, times: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, period) of repetitions in s[a:b] that hold both sides of m, of least length and times periods at least; as long as s[a:b] allows.

    With period p, one of the two sides holds p words or more besides those that are equal to them.
    """
    left, right = s[a:m], s[m:b]
    nl, nr = len(left), len(right)
    ahead = z_values(right)  # right from p on, with right
    behind = z_values([*reversed(left), -1, *reversed(right), *reversed(left)])  # suffixes of left + right[:p], with left's
    back = z_values(left[::-1])  # suffixes of left without its last p, with left's
    fore = z_values([*right, -1, *left, *right])  # left from -p on, with right
    for p in range(1, (b - a) // times + 1):
        # the run reaches p words or more to the right: its words up to m and p further on
        if p <= nr:
            after = ahead[p] if p < nr else 0
            before = min(behind[nl + 1 + nr - p], nl)
            if before and after + before + p >= max(least, times * p):
                yield m - before, m + p + after, p
        # or to the left
        if p <= nl:
            after = min(fore[nr + 1 + nl - p], nr)
            before = back[p] if p < nl else 0
            if after and after + before + p >= max(least, times * p):
                yield m - p - before, m + after, p


def runs(ids: list[int], least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period."""
    found: dict[tuple[int, int], int] = {}
    for first, end in segments(ids, least, times):
        parts = [(first, end)]
        while parts:
            a, b = parts.pop()
            if b - a < least:
                continue
            m = (a + b) // 2
            parts += [(a, m), (m, b)]
            for x, y, p in crossing(ids, a, m, b, least, times):
                # what goes on beyond this part is found whole in the part that it crosses the middle of
                if (x > first and ids[x - 1] == ids[x - 1 + p]) or (y < end and ids[y] == ids[y - p]):
                    continue
                if p < found.get((x, y), p + 1):  # multiples of the period give the same stretch
                    found[x, y] = p
    return sorted((x, y - x, p) for (x, y), p in found.items())


def perturbed(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words of one document in ten from some place on become repetitions of what stands there, as its id's checksum says."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """Words without those that repeat the first period of a run."""
    if not found:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        edge[start + period] += 1
        edge[start + length] -= 1
    return [w for w, gone in zip(words, np.cumsum(edge).tolist(), strict=False) if not gone]


RESULT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
SPANS = "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").split()


def detect(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """doc_id, every run, and the text without what repeats (words joined by a space)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 512) for b in batches for i in range(0, b.num_rows, 512)):
            rows, texts = [], []
            for text in batch.column("text").to_pylist():
                words = _words(text)
                found = runs(ids_of(words), least, times)
                rows.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in found])
                texts.append(b" ".join(collapsed(words, found)).decode("utf-8"))
            kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, kind), pa.array(texts, pa.string())], ["doc_id", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, SPANS)


def report(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """RESULT: runs of each document after perturbed(), the one of the greatest exponent, and digests."""

    def one(doc_id: int | None, text: str | None) -> tuple:
        words = perturbed(_words(text), doc_id)
        found = runs(ids_of(words), least, times)
        best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
        said = "".join(f"{a},{n},{p}\n" for a, n, p in found).encode()
        kept = b" ".join(collapsed(words, found))
        return (len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, hashlib.sha256(said).hexdigest(), hashlib.sha256(kept).hexdigest())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [*[pa.int64()] * 5, *[pa.string()] * 2]
        for batch in (b.slice(i, 512) for b in batches for i in range(0, b.num_rows, 512)):
            rows = [one(*x) for x in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], [x.split()[0] for x in RESULT.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, RESULT)


def query(spark, sf_dir: str) -> DataFrame:
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
