"""Suffix-array dedup: bytes covered by strings of LENGTH bytes that start more than once.

A string of LENGTH bytes holds a least hash among those of its GRAM-byte
substrings; equal strings have equal least hashes.  So every start in a text has
a key, runs of starts with one key make a segment, and equal strings can only
be in segments of one key.  Keys that occur once are dropped; segments of equal
content are counted, and kept once.  The segments that are left are sorted in
collections of bounded size, column by column: they are aligned on their key's gram, so that equal
strings stand in the same columns, and from the last column to the first each round inserts
one symbol of every segment, which gives the column's Burrows-Wheeler transform,
the new order and the new common prefixes; these are rewritten from one
external file to the next, in order.  A start is repeated if a common prefix of LENGTH or more
with a neighbour begins at it.

Texts that are equal are one text, with the number of its copies.  A key of more than MANY segments, such
as a passage of a third of all texts in different surroundings, would be one long task; its strings are counted by hash instead.

Defined results: null text is empty; texts shorter than LENGTH lose nothing;
rows of one doc_id are documents of their own; removed bytes may cut a
character, and hashes are of bytes; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

LENGTH, GRAM = 400, 100
#: Segments of a key beyond which it isn't sorted in one task, but its windows are counted; either way is exact.
MANY = 50_000
#: Starts hashed at a time; starts of one segment at most; bytes of one collection.
CHUNK, RUN, COLLECTION = 1 << 16, 512, 12_000_000
FILTER_BITS = 22
MULT = 0x9FB21C651E98DF25


class Hashes:
    """Keys of all starts of a text, and of its segments."""

    def __init__(self, length: int, gram: int):
        self.length, self.gram = length, gram
        size = CHUNK + length + 1
        rng = np.random.default_rng(1)
        self.of_byte = rng.integers(1, 2**64 - 1, 256, dtype=np.uint64) | np.uint64(1)
        self.power = np.multiply.accumulate(np.full(size, MULT, np.uint64))
        self.back = np.multiply.accumulate(np.full(size, pow(MULT, -1, 1 << 64), np.uint64))

    def _sums(self, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(self.of_byte[b] * self.power[: len(b)], out=out[1:])
        return out

    @staticmethod
    def _mixed(h: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(29))

    def grams(self, b: np.ndarray, sums: np.ndarray) -> np.ndarray:
        return self._mixed((sums[self.gram :] - sums[: -self.gram]) * self.back[: len(b) - self.gram + 1])

    def keys(self, b: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The gram hashes, and the least of them in each window of `length` bytes."""
        w = self.length - self.gram + 1
        h = self.grams(b, sums)
        x = np.full(-(-len(h) // w) * w, np.iinfo(np.uint64).max, np.uint64)
        x[: len(h)] = h
        x = x.reshape(-1, w)
        before = np.minimum.accumulate(x, 1).ravel()
        after = np.minimum.accumulate(x[:, ::-1], 1)[:, ::-1].ravel()
        n = len(h) - w + 1
        return h, np.minimum(after[:n], before[w - 1 : w - 1 + n])

    def runs(self, raw: bytes) -> tuple[np.ndarray, ...]:
        """Key, content hash, first start, number of starts, and weight of each segment of a text.

        The weight is 2 if the segment may hold a string twice.  Then the gram that gives
        the key stands at two places: its leftmost place in the earlier string is a start of the segment,
        its rightmost one in the later string ends a window of it, and they differ.
        """
        out = []
        for a in range(0, max(0, len(raw) - self.length + 1), CHUNK):
            b = np.frombuffer(raw, np.uint8, min(len(raw) - a, CHUNK + self.length - 1), a)
            sums = self._sums(b)
            h, key = self.keys(b, sums)
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            if np.diff(np.append(first, len(key))).max() > RUN:
                first = np.concatenate([np.arange(s, e, RUN) for s, e in zip(first, np.append(first[1:], len(key)), strict=True)])
            n = np.diff(np.append(first, len(key)))
            content = self._mixed((sums[first + n + self.length - 1] - sums[first]) * self.back[first] + n.astype(np.uint64))
            opens, w = np.flatnonzero(h[: len(key)] == key), self.length - self.gram + 1
            shuts = np.flatnonzero(h[w - 1 :] == key)
            left, right = np.full(len(first), len(h)), np.full(len(first), -1)
            np.minimum.at(left, np.searchsorted(first, opens, "right") - 1, opens)
            np.maximum.at(right, np.searchsorted(first, shuts, "right") - 1, shuts + w - 1)
            out.append((key[first], content, first + a, n, 1 + (right > left)))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (*[np.zeros(0, np.uint64)] * 2, *[np.zeros(0, np.int64)] * 3)


class External:
    """An array that lives in two files of a folder, rewritten in turn from front to back."""

    def __init__(self, folder: str, name: str, dtype, size: int):
        self.files = [np.memmap(os.path.join(folder, f"{name}{i}"), dtype, "w+", shape=size + 1) for i in (0, 1)]
        self.n = 0

    def now(self) -> np.ndarray:
        return self.files[0][: self.n]

    def padded(self) -> np.ndarray:
        return self.files[0][: self.n + 1]

    def replace(self, values: np.ndarray) -> None:
        self.files.reverse()
        self.n = len(values)
        self.files[0][: self.n] = values

    def prepend(self, values: np.ndarray) -> None:
        source, target = self.files
        target[: len(values)] = values
        target[len(values) : len(values) + self.n] = source[: self.n]
        self.files.reverse()
        self.n += len(values)


def _least(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least of values[low..high] of each pair; values has one more element than is looked at."""
    out = np.zeros(len(low), values.dtype)
    if len(low):
        order = np.argsort(-low)  # descending, so that what lies between two ranges isn't looked at
        at = np.stack([low[order], high[order] + 1], 1).ravel()
        out[order] = np.minimum.reduceat(values, at)[::2]
    return out


def repeated_starts(text: np.ndarray, first: np.ndarray, size: np.ndarray, column: np.ndarray, length: int) -> np.ndarray:
    """For each byte of text, whether the `length` bytes from there on are also in another row at the same column.

    Rows are text[first : first + size], with their first bytes at `column`.  From the last column to the first, each
    round takes the rows' symbols there in the present order: this is the collection's transform of that column.  Rows that end here
    come in, least of all; sorting by symbol, stably, orders all rows by what follows; the common prefix of two neighbours of
    one symbol is one more than the least between them before.
    """
    end = column + size
    hit = np.zeros(len(text) + 1, bool)
    enter = np.argsort(-end, kind="stable")
    left, rows = 0, len(first)
    with tempfile.TemporaryDirectory() as folder:
        order, common = External(folder, "order", np.int32, rows), External(folder, "common", np.uint16, rows)
        for at in range(int(end.max(initial=0)) - 1, int(column.min(initial=0)) - 1, -1):
            come = left
            while come < rows and end[enter[come]] > at:
                come += 1
            if come > left:
                order.prepend(enter[left:come])
                common.prepend(np.zeros(come - left, np.uint16))
                left = come
            now = order.now()
            place = first[now] + (at - column[now])
            here = np.flatnonzero(column[now] <= at)
            transform = text[place[here]]
            by = np.argsort(transform, kind="stable")
            here, transform = here[by], transform[by]
            new = np.zeros(len(here), np.uint16)
            same = np.flatnonzero(transform[1:] == transform[:-1]) + 1
            new[same] = np.minimum(_least(common.padded(), here[same - 1] + 1, here[same]) + 1, length)
            deep = new >= length
            deep[:-1] |= deep[1:]
            hit[place[here[deep]]] = True
            order.replace(now[here])
            common.replace(new)
    return hit[:-1]


def intervals(flags: np.ndarray) -> tuple[list[int], list[int]]:
    """Starts and ends (exclusive) of the runs of true values."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()


def aligned(raw: bytes, key: int, hashes: Hashes) -> list[tuple[int, int, int]]:
    """Runs (first start, number of starts, offset of the first start from the gram) of the starts of a segment, by the leftmost place of the key's gram."""
    b = np.frombuffer(raw, np.uint8)
    places = np.flatnonzero(hashes.grams(b, hashes._sums(b)) == key)
    starts = np.arange(len(b) - hashes.length + 1)
    gram = places[np.searchsorted(places, starts)]
    a = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))
    return list(zip(a.tolist(), np.diff(np.append(a, len(starts))).tolist(), (a - gram[a]).tolist(), strict=True))


def sorted_group(segments: list[bytes], keys: np.ndarray, hashes: Hashes) -> list[np.ndarray]:
    """Repeated starts of segments; only segments of one key can have strings in common."""
    rows, base = [], 0
    for raw, key in zip(segments, keys, strict=True):
        rows += [(base + a, n + hashes.length - 1, column) for a, n, column in aligned(raw, key, hashes)]
        base += len(raw)
    first, size, column = np.array(rows, np.int64).T
    hit = repeated_starts(np.frombuffer(b"".join(segments), np.uint8), first, size, column, hashes.length)
    ends = np.cumsum([len(x) for x in segments])
    return [hit[e - len(x) : e - hashes.length + 1] for x, e in zip(segments, ends, strict=True)]


def describe(docs: DataFrame, length: int) -> DataFrame:
    """doc_id, fp (MD5 of the text), n_bytes, sha256, runs of every document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes(length, GRAM * length // LENGTH)
        for batch in (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256)):
            raws = [(t or "").encode("utf-8") for t in batch.column("text").to_pylist()]
            runs = [hashes.runs(r) for r in raws]
            flat = [np.concatenate(x) for x in zip(*runs, strict=True)]
            items = pa.StructArray.from_arrays([pa.array(flat[0].view(np.int64)), pa.array(flat[1].view(np.int64)), pa.array(flat[2].astype(np.int32)), pa.array(flat[3].astype(np.int32)), pa.array(flat[4].astype(np.int8))], ["v", "seg", "s", "n", "w"])
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(r[0]) for r in runs])).astype(np.int32)), items)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([hashlib.md5(r).digest() for r in raws]), pa.array([len(r) for r in raws], pa.int64()), pa.array([hashlib.sha256(r).hexdigest() for r in raws]), lists],
                ["doc_id", "fp", "n_bytes", "sha256", "runs"],
            )

    return docs.mapInArrow(work, "doc_id long, fp binary, n_bytes long, sha256 string, runs array<struct<v:long,seg:long,s:int,n:int,w:tinyint>>")


def thinned(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Documents (id, fp, raw) that may be among ids, by a filter of a fixed size on id."""
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << FILTER_BITS)).cast("int")
    bits = np.zeros(1 << FILTER_BITS, bool)
    bits[np.array(ids.select(bucket(F.col("id")).alias("b")).distinct().toArrow().column("b"), np.int64)] = True
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(bits))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            hit = batch.filter(pa.array(bits[batch.column("b").to_numpy(zero_copy_only=False)]))
            for i in range(0, hit.num_rows, 256):
                raws = [(t or "").encode("utf-8") for t in hit.column("text").slice(i, 256).to_pylist()]
                yield pa.RecordBatch.from_arrays([hit.column("id").slice(i, 256), pa.array([hashlib.md5(r).digest() for r in raws]), pa.array(raws, pa.binary())], ["id", "fp", "raw"])

    d = docs.select(_id().alias("id"), "text").withColumn("b", bucket(F.col("id")))
    return d.mapInArrow(keep, "id long, fp binary, raw binary")


def _id():
    return F.coalesce(F.col("doc_id"), F.lit(-(1 << 62))).cast("long")


def repeats(segments: DataFrame, length: int) -> DataFrame:
    """(v, seg, starts, ends): intervals of repeated starts of the segments (v, seg, raw)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes(length, GRAM * length // LENGTH)

        def done(rows):
            keys = np.array([r[0] for r in rows], np.int64).view(np.uint64)
            got = [(v, s, *intervals(f)) for (v, s, _), f in zip(rows, sorted_group([r[2] for r in rows], keys, hashes), strict=True)]
            got = [g for g in got if g[2]]
            columns = list(zip(*got, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), *(pa.array(c, pa.list_(pa.int32())) for c in columns[2:])], ["v", "seg", "starts", "ends"])

        held, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("v", "seg", "raw")), strict=True):
                if size > COLLECTION and row[0] != held[-1][0]:
                    yield from done(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[2])
        if held:
            yield from done(held)

    n = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = segments.repartition(n, "v").sortWithinPartitions("v", "seg")
    return ordered.mapInArrow(work, "v long, seg long, starts array<int>, ends array<int>")


def repeats_of_crowds(segments: DataFrame, length: int) -> DataFrame:
    """The same for keys with too many segments for one task: windows' hashes are counted, aggregated before the shuffle.

    The hash has 64 bits and is counted within its key.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes(length, GRAM * length // LENGTH)
        for batch in batches:
            for v, seg, raw in zip(*(batch.column(c).to_pylist() for c in ("v", "seg", "raw")), strict=True):
                sums = hashes._sums(np.frombuffer(raw, np.uint8))
                h = hashes._mixed((sums[length:] - sums[:-length]) * hashes.back[: len(raw) - length + 1])
                n = len(h)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, v)), pa.array(np.full(n, seg)), pa.array(np.arange(n, dtype=np.int32)), pa.array(h.view(np.int64))], ["v", "seg", "at", "h"])

    every = segments.mapInArrow(work, "v long, seg long, at int, h long")
    twice = materialize(every.groupBy("v", "h").agg(F.count("*").alias("c")).where("c > 1").select("v", "h"), "twice")
    hit = every.join(twice, ["v", "h"]).groupBy("v", "seg").agg(F.array_sort(F.collect_list("at")).alias("starts"))
    return hit.select("v", "seg", "starts", F.transform("starts", lambda a: a + 1).alias("ends"))


def dedup(docs: DataFrame, length: int = LENGTH, many: int = MANY) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_starts and kept_ends of what was removed."""
    docs = docs.select("doc_id", "text")
    every = materialize(describe(docs, length), "runs")
    texts = materialize(every.groupBy("fp").agg(F.count("*").alias("copies"), F.min(F.struct(_id().alias("id"), "n_bytes", "runs")).alias("x")).select("fp", "copies", "x.*"), "texts")
    # texts with copies are removed whole, and are there to be met by others
    e = texts.select("fp", "id", "copies", F.explode("runs").alias("r")).select("fp", "id", "copies", "r.*")
    often = materialize(e.groupBy("v").agg(F.sum(F.col("copies") * F.col("w")).alias("c")).where("c > 1").select("v"), "keys")
    e = materialize(e.join(often, "v"), "met")
    g = materialize(e.groupBy("v", "seg").agg(F.sum("copies").alias("c"), F.max("w").alias("w"), F.min(F.struct("id", "fp", "s", "n")).alias("at")), "segments")
    several = g.groupBy("v").agg(F.sum("w").alias("k"), F.count("*").alias("n_seg")).where("k > 1").select("v", (F.col("n_seg") > many).alias("crowd"))
    wanted = materialize(g.join(several, "v").select("v", "seg", "crowd", "at.*"), "wanted")
    by_text = wanted.groupBy("id", "fp").agg(F.collect_list(F.struct("v", "seg", "crowd", "s", "n")).alias("parts"))
    cut = thinned(docs, wanted).join(by_text, ["id", "fp"]).select("raw", F.explode("parts").alias("p"))
    cut = cut.select("p.v", "p.seg", "p.crowd", F.expr("substring(raw, p.s + 1, p.n + %d)" % (length - 1)).alias("raw")).dropDuplicates(["v", "seg"])
    cut = materialize(cut, "cut")
    inner = repeats(cut.where("not crowd").drop("crowd"), length)
    if wanted.where("crowd").take(1):
        inner = inner.unionByName(repeats_of_crowds(cut.where("crowd").drop("crowd"), length))
    inner = materialize(inner, "repeats")
    # all occurrences of a segment: the whole of it if there are several, else the intervals found
    hit = g.join(inner, ["v", "seg"], "left").where("c > 1 or starts is not null")
    hit = materialize(hit.select("v", "seg", F.when(F.col("c") > 1, F.array(F.lit(0))).otherwise(F.col("starts")).alias("a"), F.when(F.col("c") > 1, F.array(F.col("at.n"))).otherwise(F.col("ends")).alias("b")), "hits")
    spans = e.where("copies = 1").join(hit, ["v", "seg"]).select("fp", "id", F.explode(F.arrays_zip("a", "b")).alias("i"), "s")
    spans = materialize(spans.groupBy("fp", "id").agg(F.array_sort(F.collect_list(F.struct((F.col("s") + F.col("i.a")).alias("a"), (F.col("s") + F.col("i.b") + length - 1).alias("b")))).alias("spans")), "spans")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                rows = []
                for fp, raw, spans in zip(*(batch.column(c).slice(i, 256).to_pylist() for c in ("fp", "raw", "spans")), strict=True):
                    edge = np.zeros(len(raw) + 1, np.int64)
                    np.add.at(edge, [s["a"] for s in spans], 1)
                    np.add.at(edge, [s["b"] for s in spans], -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    a, b = intervals(gone)
                    rows.append((fp, int(gone.sum()), a, b, hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest()))
                c = list(zip(*rows, strict=True))
                ints = pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.binary()), pa.array(c[1], pa.int64()), pa.array(c[2], ints), pa.array(c[3], ints), pa.array(c[4])], ["fp", "n_removed", "starts", "ends", "kept"])

    some = thinned(docs, spans).join(spans, ["id", "fp"]).select("fp", "raw", "spans").mapInArrow(remove, "fp binary, n_removed long, starts array<int>, ends array<int>, kept string")
    some = materialize(some.dropDuplicates(["fp"]).withColumn("whole", F.lit(False)), "removed")
    none = F.array().cast("array<int>")
    whole = texts.where((F.col("copies") > 1) & (F.col("n_bytes") >= length)).select("fp", F.col("n_bytes").alias("n_removed"), F.array(F.lit(0)).alias("starts"), F.array(F.col("n_bytes").cast("int")).alias("ends"), F.sha2(F.lit("").cast("binary"), 256).alias("kept"))
    result = materialize(some.drop("whole").unionByName(whole), "results")
    out = every.select("doc_id", "fp", "n_bytes", "sha256").join(result, "fp", "left")
    return out.select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.size(F.coalesce("starts", none)).cast("long").alias("n_spans"),
        F.coalesce("kept", "sha256").alias("kept_sha256"), F.coalesce("starts", none).alias("removed_starts"), F.coalesce("ends", none).alias("removed_ends"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", (F.col("n_removed") > 0).alias("has_repeats"))
