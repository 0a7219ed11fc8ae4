"""LM scoring: an interpolated modified Kneser-Ney model of any order from 2, counted in Spark.

Words: a first pass counts the training words by 64-bit hashes and numbers them, frequent ones
first (within a shard; numbers of shards take turns), so that a gram is a row of 32-bit numbers
with small values.

Counting: every task turns its training texts into grams, counts them within blocks of BLOCK
tokens and deals the blocks out by context, sorted and compressed.  A reducer adds up its
shard, writes tables of pairs and contexts to the shared folder, and hands on the distinct grams without their
first word, which make the next lower order's counts in the same way: each distinct gram counts
once.  The lowest order hands on each word's number of contexts.  Counts are whole: nothing is pruned.
A context with a third of all tokens arrives as at most one count a word and block.
Shuffle files and tables that are read no more go between the orders.

Tables: sorted 64-bit hashes of which the bucket tells the first bits and 40 more are kept (all, where two of a table
would be equal), so an unseen gram is taken for a seen one once in some 10**10 lookups.  Counts are bytes, greater ones
listed apart; contexts that were seen once need no counts.

Scoring: workers memory-map the tables; a slice of texts looks up its distinct
pairs, contexts and words in sorted order, so reads run through the arrays.

P(w|u) = (max(c(uw) - D, 0) + mass(u) * Pc(w)) / c(u), Pc from numbers of
contexts, interpolated with 1/(V+1); each level has three discounts, estimated
from its counts of counts; at higher orders the next lower order's P takes the place of Pc.
A text is its words, A-Z lowered, then an end; its first context is start marks.

Defined results: null or blank text is the end token alone; a null doc_id is in
the training part; without training tokens every probability is 1; repeated
rows count as often as they come; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, mix, new_folder, release, word_hashes
from .files import mapped, write_bytes

END = np.uint64(0x0123456789ABCDEF)
ORDER, BLOCK, SLICE = 3, 2_000_000, 1024
MULT = np.uint64(0x9FB21C651E98DF25)
#: Numbers of words: start marks, then the training words, and at the end those that training doesn't have.
START, UNKNOWN = 0, (1 << 32) - 1
#: log2 of a bucket's keys, and bits of a key that a table leaves out.
BUCKET, LEFT = 3, np.uint64(24)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def pair_hash(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(context * MULT + word)


def context_hash(contexts: np.ndarray) -> np.ndarray:
    """One hash of each row of words."""
    h = np.ones(len(contexts), np.uint64)
    for i in range(contexts.shape[1]):
        h = pair_hash(h, contexts[:, i].astype(np.uint64))
    return h


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes and lengths of the texts, one after the other, each with its end."""
    hashes = [np.append(word_hashes(t), END) for t in texts]
    return np.concatenate(hashes), np.array([len(h) for h in hashes])


def grams(ids: np.ndarray, sizes: np.ndarray, order: int) -> np.ndarray:
    """Each word behind its order - 1 words of context, as a row."""
    at = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = np.full((len(ids), order), START, np.uint32)
    for back in range(order):
        inside = np.flatnonzero(at >= back)
        out[inside, order - 1 - back] = ids[inside - back]
    return out


def distinct(rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct rows of 32-bit numbers; their counts' sums."""
    wide = rows.astype(np.uint64)
    odd = wide.shape[1] % 2
    keys = [wide[:, 0]] * odd + [wide[:, i] << np.uint64(32) | wide[:, i + 1] for i in range(odd, wide.shape[1], 2)]
    order = np.argsort(keys[-1])
    for k in keys[-2::-1]:  # in less time than lexsort
        order = order[np.argsort(k[order], kind="stable")]
    new = np.ones(len(rows), bool)
    new[1:] = np.any([np.diff(k[order]) != 0 for k in keys], 0)
    first = np.flatnonzero(new)
    return rows[order[first]], np.add.reduceat(counts[order], first) if len(first) else counts[:0]


def deal(rows: np.ndarray, counts: np.ndarray, shards: int) -> Iterator[tuple[int, bytes]]:
    """The distinct grams and their counts, in a compressed block a shard of contexts: low bytes of a column first, then the next ones."""
    shard = (context_hash(rows[:, :-1]) % np.uint64(shards)).astype(np.uint32)
    rows, counts = distinct(np.column_stack([shard, rows]), counts)
    cuts = np.searchsorted(rows[:, 0], np.arange(shards + 1))
    for s in np.flatnonzero(np.diff(cuts)).tolist():
        own = rows[cuts[s] : cuts[s + 1], 1:]
        columns = np.vstack([np.diff(own[:, 0], prepend=np.uint32(0)), own[:, 1:].T, counts[cuts[s] : cuts[s + 1]].astype(np.uint32)])
        planes = columns.reshape(*columns.shape, 1).view(np.uint8).transpose(0, 2, 1)
        yield s, np.array([columns.shape], np.int64).tobytes() + pa.Codec("zstd", compression_level=3).compress(planes.tobytes(), asbytes=True)


def dealt(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Grams and counts of a block."""
    width, n = np.frombuffer(raw, np.int64, 2).tolist()
    planes = np.frombuffer(pa.Codec("zstd").decompress(raw[16:], 4 * width * n, asbytes=True), np.uint8).reshape(width, 4, n)
    columns = np.ascontiguousarray(planes.transpose(0, 2, 1)).view(np.uint32)[:, :, 0]
    return np.column_stack([np.cumsum(columns[0], dtype=np.uint32), *columns[1:-1]]), columns[-1].astype(np.int64)


def narrow(c: np.ndarray) -> np.ndarray:
    """Counts in 32 bits where all of a file's fit, else in 64; the file's size tells which."""
    return c.astype(np.uint32 if c.max(initial=0) < 1 << 32 else np.int64)


def _of_counts(c: np.ndarray) -> list[int]:
    return [int((c == k).sum()) for k in (1, 2, 3, 4)]


def table(keys: np.ndarray, *counts: np.ndarray) -> list[bytes]:
    """The chunks of a table's file; keys: 64-bit hashes."""
    order = np.argsort(keys)
    keys, counts = keys[order], [c[order] for c in counts]
    bits = max(0, len(keys).bit_length() - BUCKET)
    bucket, rest = keys >> np.uint64(64 - bits) if bits else keys * np.uint64(0), keys << np.uint64(bits)
    kept = rest >> LEFT
    whole = bool(((np.diff(kept) == 0) & (np.diff(bucket) == 0)).any())
    many = [np.flatnonzero(c > 254) for c in counts]
    chunks = [np.array([len(keys), bits, whole, len(counts), *map(len, many)], np.int64)]
    chunks += [c[m].astype(np.int64) for c, m in zip(counts, many, strict=True)]
    chunks += [np.searchsorted(bucket, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.uint32), *(m.astype(np.uint32) for m in many)]
    chunks += [kept.astype(np.uint32), (rest & np.uint64((1 << 24) - 1)).astype(np.uint32)][: 1 + whole]
    chunks += [(kept >> np.uint64(32)).astype(np.uint8), *(np.minimum(c, 255).astype(np.uint8) for c in counts)]
    return [c.tobytes() for c in chunks]


class Table:
    """A table, read in place."""

    def __init__(self, raw: np.ndarray):
        at = 0

        def take(n: int, kind) -> np.ndarray:
            nonlocal at
            size = n * np.dtype(kind).itemsize
            at += size
            return raw[at - size : at].view(kind)

        self.n, self.bits, whole, columns = take(4, np.int64).tolist()
        many = take(columns, np.int64).tolist()
        values = [take(n, np.int64) for n in many]
        self.starts = take((1 << self.bits) + 1, np.uint32)
        self.many = list(zip((take(n, np.uint32) for n in many), values, strict=True))
        self.low, self.left = take(self.n, np.uint32), take(self.n, np.uint32) if whole else None
        self.high, self.columns = take(self.n, np.uint8), [take(self.n, np.uint8) for _ in range(columns)]

    def key(self, at: np.ndarray) -> np.ndarray:
        k = self.low[at] | self.high[at].astype(np.uint64) << np.uint64(32)
        return k if self.left is None else k << LEFT | self.left[at]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys it has, and the rows of those."""
        want = keys << np.uint64(self.bits)
        want = want >> LEFT if self.left is None else want
        bucket = (keys >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(keys), np.int64)
        low, high = self.starts[bucket].astype(np.int64), self.starts[bucket + 1].astype(np.int64)
        end = high
        for _ in range(int((high - low).max(initial=0)).bit_length()):
            middle = (low + high) >> 1
            less = (self.key(np.minimum(middle, self.n - 1)) < want) & (low < high)
            low, high = np.where(less, middle + 1, low), np.where(less, high, middle)
        hit = low < end
        hit[hit] = self.key(low[hit]) == want[hit]
        return hit, low[hit]

    def counts(self, at: np.ndarray) -> Iterator[np.ndarray]:
        for small, (places, values) in zip(self.columns, self.many, strict=True):
            c = small[at].astype(np.int64)
            if (big := c == 255).any():
                c[big] = values[np.searchsorted(places, at[big])]
            yield c


def by_shard(shard: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each shard that occurs, and its rows in their order."""
    order = np.argsort(shard.astype(np.uint16 if shards < 1 << 16 else np.uint32), kind="stable")  # 16 bits take a pass each
    cuts = np.searchsorted(shard[order], np.arange(shards + 1, dtype=np.uint64))
    for s in np.flatnonzero(np.diff(cuts)).tolist():
        yield s, order[cuts[s] : cuts[s + 1]]


def alike(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, the place of one of each, and each key's number among them."""
    order = np.argsort(keys)
    keys = keys[order]
    new = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    number = np.empty(len(keys), np.int64)
    number[order] = np.cumsum(new) - 1
    return keys[new], order[new], number


class Words:
    """The memory-mapped numbers and counts of the training words."""

    def __init__(self, manifest: list, shards: int):
        self.shards, self.files = shards, {}
        for kind, shard, uri, _, n, *_ in manifest:
            if kind == "word":
                raw = np.asarray(mapped(uri, np.uint8))
                self.files[shard] = raw[: 8 * n].view(np.uint64), raw[8 * n : 12 * n].view(np.uint32), raw[12 * n :].view(np.uint32 if len(raw) == 16 * n else np.int64)

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and counts of sorted word hashes."""
        ids, c = np.full(len(words), UNKNOWN, np.uint32), np.zeros(len(words), np.int64)
        for s, rows in by_shard(words % np.uint64(self.shards), self.shards):
            if s in self.files:
                known, number, count = self.files[s]
                at = np.minimum(np.searchsorted(known, words[rows]), len(known) - 1)
                hit = known[at] == words[rows]
                ids[rows[hit]], c[rows[hit]] = number[at[hit]], count[at[hit]]
        return ids, c


MANIFEST = "kind string, shard int, block binary, uri string, total long, distinct_n long, n1 long, n2 long, n3 long, n4 long"


def _row(kind: str, shard: int, block: bytes | None = None, uri: str | None = None, total: int = 0, distinct: int = 0, n=(0, 0, 0, 0)) -> pa.RecordBatch:
    names = [x.split()[0] for x in MANIFEST.split(", ")]
    types = [pa.string(), pa.int32(), pa.binary(), pa.string(), *[pa.int64()] * 6]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((kind, shard, block, uri, total, distinct, *n), types, strict=True)], names)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    by: dict[int, list] = {}
    for batch in batches:
        for s, raw in zip(batch.column("shard").to_pylist(), batch.column("block").to_pylist(), strict=True):
            by.setdefault(s, []).append(raw)
    for s in sorted(by):
        yield s, by.pop(s)


def train(docs: DataFrame, order: int = 2) -> list:
    """Count the texts of docs and write the model; its manifest, one row a file."""
    spark = docs.sparkSession
    folder = new_folder(spark, "lm")
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Word hashes and lengths of some BLOCK tokens at a time."""
        some, size = [], 0
        for batch in (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
            some.append(tokens(batch.column("text").to_pylist()))
            size += len(some[-1][0])
            if size >= BLOCK:
                yield tuple(map(np.concatenate, zip(*some, strict=True)))
                some, size = [], 0
        if some:
            yield tuple(map(np.concatenate, zip(*some, strict=True)))

    def block(s: int, raw: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([raw], pa.binary())], ["shard", "block"])

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, _ in held(batches):
            word, n = np.unique(h, return_counts=True)
            for s, rows in by_shard(word % np.uint64(shards), shards):
                yield block(s, word[rows].tobytes() + n[rows].astype(np.uint32).tobytes())

    def add_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, raws in _gathered(batches):
            h = np.concatenate([np.frombuffer(x, np.uint64, len(x) // 12) for x in raws])
            n = np.concatenate([np.frombuffer(x, np.uint32, len(x) // 12, len(x) // 12 * 8) for x in raws]).astype(np.int64)
            word, _, at = alike(h)
            c = np.zeros(len(word), np.int64)
            np.add.at(c, at, n)
            rank = np.empty(len(word), np.int64)
            rank[np.argsort(-c, kind="stable")] = np.arange(len(word))
            number = 1 + s + rank * shards
            if number.max(initial=0) >= UNKNOWN:
                raise ValueError("more words than 32 bits can number")
            uri = write_bytes(folder, f"word-{s}", [word.tobytes(), number.astype(np.uint32).tobytes(), narrow(c).tobytes()])
            yield _row("word", s, uri=uri, total=int(c.sum()), distinct=len(word))

    def add_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, raws in _gathered(batches):
            g, c = distinct(*map(np.concatenate, zip(*map(dealt, raws), strict=True)))
            level, u = g.shape[1], context_hash(g[:, :-1])
            key = pair_hash(u, g[:, -1].astype(np.uint64))
            yield _row(f"pair-{level}", s, uri=write_bytes(folder, f"pair-{level}-{s}", table(key, c)), distinct=len(key), n=_of_counts(c))
            first = np.flatnonzero(np.append(True, (g[1:, :-1] != g[:-1, :-1]).any(1)))
            total, *n = (np.add.reduceat(x.astype(np.int64), first) for x in (c, c == 1, c == 2, c > 2))
            once = total == 1
            yield _row(f"once-{level}", s, uri=write_bytes(folder, f"once-{level}-{s}", table(u[first][once])), distinct=int(once.sum()))
            yield _row(f"context-{level}", s, uri=write_bytes(folder, f"context-{level}-{s}", table(u[first][~once], *(x[~once] for x in (*n, total)))), distinct=int((~once).sum()))
            if level > 2:  # every distinct gram counts once for the gram without its first word
                for t, raw in deal(g[:, 1:], np.ones(len(g), np.int64), shards):
                    yield _row("lower", t, block=raw)
            else:  # and for its word
                word, n = np.unique(g[:, -1] - 1, return_counts=True)
                for t, rows in by_shard((word % shards).astype(np.uint64), shards):
                    yield _row("near", t, block=np.column_stack([word[rows] // shards, n[rows]]).astype(np.uint32).tobytes())

    def add_near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, raws in _gathered(batches):
            rank, n = np.concatenate([np.frombuffer(x, np.uint32).reshape(-1, 2) for x in raws]).astype(np.int64).T
            near = np.zeros(rank.max(initial=-1) + 1, np.int64)
            np.add.at(near, rank, n)
            yield _row("near", s, uri=write_bytes(folder, f"near-{s}", [narrow(near).tobytes()]), distinct=len(near), n=_of_counts(near))

    def step(blocks: DataFrame, add) -> DataFrame:
        return materialize(blocks.repartition(shards, "shard").mapInArrow(add, MANIFEST), "lm")

    def files(made: DataFrame) -> list:
        """A few numbers a file."""
        rows = made.where("uri is not null").select("kind", "shard", "uri", "total", "distinct_n", "n1", "n2", "n3", "n4").collect()
        release(spark)
        return [tuple(r) for r in rows]

    manifest = files(step(docs.select("text").mapInArrow(count_words, "shard int, block binary"), add_words))
    numbered = spark.sparkContext.broadcast(manifest)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(numbered.value, shards)
        for h, sizes in held(batches):
            word, _, at = alike(h)
            g = grams(words.find(word)[0][at], sizes, order)
            for s, raw in deal(g, np.ones(len(g), np.int64), shards):
                yield block(s, raw)

    made = step(docs.select("text").mapInArrow(count, "shard int, block binary"), add_grams)
    manifest = manifest + files(made)
    for level in range(order - 1, 0, -1):
        before, made = made, step(made.where("block is not null").select("shard", "block"), add_grams if level > 1 else add_near)
        discard(before)
        manifest += files(made)
    return manifest


def discounts(n: list[int]) -> np.ndarray:
    """Discounts by count 0, 1, 2, 3+, from the numbers of entries with counts 1 to 4."""
    n1, n2, n3, n4 = n
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.0
    d = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return np.array([0.0, *(float(np.clip(x, 0.05, k - 0.05)) for k, x in enumerate(d, 1))])


def order_of(manifest) -> int:
    return max((int(r[0].split("-")[1]) for r in manifest if "-" in r[0]), default=2)


class Model:
    """The memory-mapped tables."""

    def __init__(self, manifest: list, shards: int):
        self.shards, self.order, self.words = shards, order_of(manifest), Words(manifest, shards)
        self.tables = {"near": {}} | {f"{k}-{i}": {} for k in ("pair", "once", "context") for i in range(2, self.order + 1)}
        sums = {k: np.zeros(6, np.int64) for k in ("word", *self.tables)}
        for kind, shard, uri, *numbers in manifest:
            sums[kind] += numbers
            if kind == "near":
                raw = np.asarray(mapped(uri, np.uint8))
                self.tables[kind][shard] = raw.view(np.uint32 if len(raw) == 4 * numbers[1] else np.int64)
            elif kind != "word":
                self.tables[kind][shard] = Table(np.asarray(mapped(uri, np.uint8)))
        self.n, self.v = int(sums["word"][0]), int(sums["word"][1])
        self.pairs = int(sums["pair-2"][1])
        self.d, self.dc = {i: discounts(sums[f"pair-{i}"][2:].tolist()) for i in range(2, self.order + 1)}, discounts(sums["near"][2:].tolist())
        n1, n2 = sums["near"][2:4].tolist()
        self.mass = self.dc[1] * n1 + self.dc[2] * n2 + self.dc[3] * (self.v - n1 - n2)

    def near(self, ids: np.ndarray) -> np.ndarray:
        """Numbers of contexts of the words with these numbers."""
        out = np.zeros(len(ids), np.int64)
        for s, rows in by_shard(((ids - 1) % self.shards).astype(np.uint64), self.shards):
            rows = rows[ids[rows] != UNKNOWN]
            if len(rows):
                out[rows] = self.tables["near"][s][(ids[rows] - 1) // self.shards]
        return out

    def find(self, kind: str, shard: np.ndarray, key: np.ndarray, out: np.ndarray) -> np.ndarray:
        """Which sorted keys there are; the counts of those go to the rows of out."""
        there = np.zeros(len(key), bool)
        for s, rows in by_shard(shard, self.shards):
            if own := self.tables[kind].get(s):
                hit, at = own.find(key[rows])
                there[rows[hit]] = True
                for row, c in zip(out, own.counts(at)):
                    row[rows[hit]] = c
        return there

    def score(self, h: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each token: its training count, base log10 probability and the model's."""
        size = np.uint64(self.shards)
        word, _, iw = alike(h)
        ids, c = self.words.find(word)
        base = np.log10((c + 1) / (self.n + 1 * (self.v + 1)))
        low, near = 1 / (self.v + 1), self.near(ids)
        pc = (np.maximum(near - self.dc[np.minimum(near, 3)], 0) + self.mass * low) / self.pairs if self.pairs else np.full(len(word), low)
        p, g = pc[iw], grams(ids[iw], sizes, self.order)
        for level in range(2, self.order + 1):
            u = context_hash(g[:, self.order - level : -1])
            pair, first, ip = alike(pair_hash(u, g[:, -1].astype(np.uint64)))
            n = np.zeros((1, len(pair)), np.int64)
            seen = self.find(f"pair-{level}", u[first] % size, pair, n)
            ctx, _, iu = alike(u)
            n1, n2, n3, total = stats = np.zeros((4, len(ctx)), np.int64)
            often = self.find(f"context-{level}", ctx % size, ctx, stats)
            once = np.zeros(len(ctx), bool)
            once[iu[first[seen]]] = True  # a seen pair's context is in one of the two tables
            rest = np.flatnonzero(~(often | once))
            once[rest] = self.find(f"once-{level}", ctx[rest] % size, ctx[rest], stats[:0])
            once &= ~often
            n1[once] = total[once] = 1
            d, t, n = self.d[level], total[iu], n[0]
            mass = (d[1] * n1 + d[2] * n2 + d[3] * n3)[iu]
            p = np.where(t > 0, (np.maximum(n - d[np.minimum(n, 3)], 0)[ip] + mass * p) / np.maximum(t, 1), p)
        return c[iw], base[iw], np.log10(p)


@lru_cache(1)
def _model(files: tuple, shards: int) -> Model:
    return Model(list(files), shards)


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"


def score(docs: DataFrame, manifest: list) -> DataFrame:
    shards = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    files = docs.sparkSession.sparkContext.broadcast(tuple(manifest))  # names and counts of the files

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(files.value, shards)
        for batch in (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
            h, sizes = tokens(batch.column("text").to_pylist())
            c, base, full = model.score(h, sizes)
            first = np.cumsum(sizes) - sizes
            add = lambda x: np.add.reduceat(x, first)
            total = add(full)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(sizes), pa.array(add((c > 0).astype(np.int64))), pa.array(np.full(len(sizes), model.n)), pa.array(add(base)), pa.array(total), pa.array(10 ** (-total / sizes))],
                [x.split()[0] for x in RESULT.split(", ")],
            )

    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(work, RESULT)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score(docs, train(docs.where(~held_out(F.col("doc_id"))), ORDER))
