"""N-gram Jaccard join: adaptive multi-match prefixes over word-shingle sets, and the components of the links.

Two documents link when 100 * |A & B| >= PERCENT * |A | B|, A and B their sets of
distinct word shingles.

1. Documents of equal sets become one class (keyed by 128 bits of its sorted set, aggregated before the shuffle).
2. Shingles are ordered from rare to frequent by a sketch of counts over all
   documents: 2**SKETCH_BITS counters, a size that doesn't grow.  Any order gives right results; a good one gives short posting lists.
3. Each class picks how many matches, l, its prefix asks for, by the estimated cost
   of its lists and candidates (see choose()), and indexes its first
   |A| - ceil(t|A|) + l shingles.  Two linked sets share at least l shingles
   within their first |A| - alpha + l ones, alpha the overlap that their sizes
   need; l is the smaller of the two's.
4. Copies that differ little would meet in every list, in pairs.  So a first round links them through minimum
   hashes to one class each, verifies that, and takes components.  The join
   proper then only pairs classes of different components: lists in which all
   belong to one component are dropped.  A class stays only as far as enough shingles of its prefix are shared by others,
   early enough for a partner of some size; the rest meet by shingle and step of size, in lists of bounded length whose
   members carry their shared shingles, so that only pairs with enough matches become rows.  No pair of texts
   in different components is left out, so the components of both rounds' links are those of all links.
5. Candidates are verified on the whole sets; only candidates' texts move for that.
6. Every link lies inside a component, so the links of a class are counted there, against all others of its component:
   components are dealt into blocks of bounded size, blocks meet in pairs where their sizes can link, and a pair of
   blocks gives one count a class, never rows of links.

Defined results: a document with fewer words than a shingle has the whole sequence as its one shingle; null or blank
text has the empty set and links with nothing, its component is its own doc_id; rows of one doc_id and several texts
are documents of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, discard, fresh, materialize, release, small_batches, window_hashes, word_hashes

SHINGLE, PERCENT = 3, 90
SKETCH_BITS, SLOTS, MAX_MATCH, VERIFY_COST, BINS, CHUNKS = 20, 16, 4, 16.0, 8, 64
FILTER_BITS, MOST_BITS, SIZE_STEP = 22, 26, 1.02
#: Members of a posting list that are looked at together.
CHUNK = 128
#: The most rounds that posting lists are met in, and how many of their members a round has before there are more.
ROUNDS, ROUND_ROWS = 4, 50_000
#: A block's bounds for counting links: classes, and shingles of all of them; shared shingles that are looked at together.
BLOCK, BLOCK_ITEMS, COLUMNS = 256, 1 << 19, 4096


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles."""
    return np.unique(window_hashes(word_hashes(text), k))


def sketch(docs: DataFrame, k: int) -> np.ndarray:
    """How often shingles of each bucket occur in all documents; on the driver, of a fixed size."""
    size = (1 << SKETCH_BITS) // SLOTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                sets = [shingle_set(t, k) for t in batch.column("text").slice(i, 256).to_pylist()]
                total += np.bincount((np.concatenate(sets) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=1 << SKETCH_BITS)
        parts = [total[s * size : (s + 1) * size] for s in range(SLOTS)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(SLOTS, dtype=np.int32)), pa.array([p.tobytes() for p in parts])], ["slot", "part"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, raw in zip(batch.column("slot").to_pylist(), batch.column("part").to_pylist(), strict=True):
                by[s] = by.get(s, 0) + np.frombuffer(raw, np.int64)
        if by:
            yield pa.RecordBatch.from_arrays([pa.array(list(by), pa.int32()), pa.array([x.tobytes() for x in by.values()])], ["slot", "part"])

    schema = "slot int, part binary"
    got = docs.select("text").mapInArrow(count, schema).repartition(SLOTS, "slot").mapInArrow(add, schema).collect()
    out = np.zeros((SLOTS, size), np.int64)
    for slot, part in got:
        out[slot] = np.frombuffer(part, np.int64)
    return out.ravel()


def need(size: np.ndarray | int, percent: int):
    """The least overlap of a set of this size with any set that it links with."""
    return -(-size * percent // 100)


def choose(weights: np.ndarray, size: int, percent: int) -> int:
    """How many matches to ask for: l costs the lists of its prefix, and the candidates that
    can be met l times in them, at most a lth of the entries, each to be verified."""
    best, least = 1, np.inf
    first = size - need(size, percent)
    lists = np.cumsum(weights[: first + MAX_MATCH])
    for m in range(1, min(MAX_MATCH, need(size, percent)) + 1):
        entries = lists[min(first + m, size) - 1]
        cost = entries + VERIFY_COST * entries / m**2
        if cost < least:
            best, least = m, cost
    return best


CLASS = "doc_id long, fp binary, n long, matches int, prefix array<long>, bins array<long>, common double"


def _describe(text: str | None, k: int, percent: int, order: np.ndarray, usual: float):
    s = shingle_set(text, k)
    n = len(s)
    if not n:
        return None, 0, 0, [], [], 0.0
    count = order[s >> np.uint64(64 - SKETCH_BITS)]
    keep = min(n, n - need(n, percent) + MAX_MATCH)
    near = np.argpartition(count, keep - 1) if keep < n else np.arange(n)
    edge = count[near[keep - 1]]
    some = np.flatnonzero(count <= edge) if keep < n else near
    by = some[np.lexsort((s[some], count[some]))][:keep]
    m = choose(np.maximum(count[by] - usual, 0.0) + 1.0, n, percent)
    # minimum of each bin: hashes by their low bits
    low = (s & np.uint64(BINS - 1)).astype(np.int64)
    first = np.unique(low, return_index=True)[1]
    return class_key(s), n, m, s[by[: n - need(n, percent) + m]].view(np.int64), s[first].view(np.int64), float(np.log1p(count).mean())


def describe(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """CLASS for every document; without words: no fp."""
    counts = sketch(docs, k)
    usual = float(np.median(counts))
    shared = docs.sparkSession.sparkContext.broadcast(counts)  # 8 * 2**SKETCH_BITS bytes

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = shared.value
        for batch in (b.slice(i, 512) for b in batches for i in range(0, b.num_rows, 512)):
            rows = [_describe(t, k, percent, order, usual) for t in batch.column("text").to_pylist()]
            fp, n, m, prefix, bins, common = zip(*rows, strict=True)
            lists = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp, pa.binary()), pa.array(n, pa.int64()), pa.array(m, pa.int32()), pa.array(prefix, lists), pa.array(bins, lists), pa.array(common, pa.float64())], [x.split()[0] for x in CLASS.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(work, CLASS)


def bounded_filter(values: DataFrame) -> np.ndarray:
    """Which buckets the longs in `v` fall in, as bits: about 16 buckets a value, but at most 2**MOST_BITS, which bounds what is collected and broadcast.

    Beyond that bound it lets more through; what it lets through is joined exactly.
    """
    n = values.count()
    bits = min(MOST_BITS, max(FILTER_BITS, int(16 * n).bit_length()))
    at = F.pmod(F.xxhash64("v"), F.lit(1 << bits))
    words = values.groupBy(F.shiftrightunsigned(at, 6).cast("int").alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(xxhash64(v), {1 << bits}) & 63 as int))")).alias("m")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words.column("w").to_numpy()] = words.column("m").to_numpy()
    return out


def in_filter(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Of xxhash64 values, which are in the filter."""
    at = hashes & (len(words) * 64 - 1)
    return (words[at >> 6] >> (at & 63) & 1).astype(bool)


def texts_of(pairs: DataFrame, docs: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """(fp, text) of the classes of the pairs (a, b)."""
    wanted = pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).distinct()
    ids = materialize(classes.join(wanted, "fp").select("fp", "locate"), "wanted")
    # keeps most other texts from being made into sets and moved
    shared = docs.sparkSession.sparkContext.broadcast(bounded_filter(ids.select(F.col("locate").alias("v"))))

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = batch.filter(pa.array(in_filter(shared.value, batch.column("hash").to_numpy())))
            for i in range(0, hit.num_rows, 512):
                texts = hit.column("text").slice(i, 512)
                fp = [class_key(shingle_set(t, k)) for t in texts.to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(fp, pa.binary()), hit.column("locate").slice(i, 512), texts], ["fp", "locate", "text"])

    key = locate(docs)
    found = docs.select("text", key.alias("locate"), F.xxhash64(key).alias("hash"))
    found = found.mapInArrow(some, "fp binary, locate long, text string").join(ids, ["fp", "locate"], "left_semi")
    return materialize(found.groupBy("fp").agg(F.min("text").alias("text")), "texts")


def verified(pairs: DataFrame, found: DataFrame, k: int, percent: int) -> DataFrame:
    """Of the pairs (a, b) of classes, those whose sets link; found: their texts.

    Texts travel, which are smaller than their sets; each text once for its pairs as b, and again with the pair to a.
    """
    of = lambda c: found.select(F.col("fp").alias(c), F.col("text").alias(f"t{c}"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple = (None, None)
        for batch in (x.slice(i, 512) for x in batches for i in range(0, x.num_rows, 512)):
            keep = []
            for a, ta, tb in zip(*(batch.column(c).to_pylist() for c in ("a", "ta", "tb")), strict=True):
                if held[0] != a:
                    held = (a, shingle_set(ta, k))
                x, y = held[1], shingle_set(tb, k)
                i = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * i >= percent * (len(x) + len(y) - i))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(of("b"), "b").join(of("a"), "a").select("a", "b", "ta", "tb").mapInArrow(check, "a binary, b binary")


def class_key(s: np.ndarray) -> bytes | None:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def locate(docs: DataFrame) -> Column:
    """What a row is found again by, without its text: its doc_id."""
    return F.coalesce(F.col("doc_id"), F.lit(-(1 << 62))).cast("long")


def first_links(members: DataFrame) -> DataFrame:
    """Candidates (a, b): each class with the one it shares the most minimum hashes with, of those that lead a hash's group.

    The class whose shingles are the most common leads: in a group of near copies that is the text they come from, or
    the one closest to it, so the copies link with it even where they are too far from each other.
    """
    e = members.where("fp is not null").groupBy("fp").agg(F.min(F.struct("bins", "common")).alias("x")).select("fp", F.size("x.bins").alias("size"), "x.common", F.explode("x.bins").alias("h"))
    e = materialize(e.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(CHUNKS)).cast("int")), "bins")
    local = e.groupBy("h", "salt").agg(F.max(F.struct("common", "fp")).alias("head"), F.count("*").alias("c"))
    top = local.groupBy("h").agg(F.max("head").alias("top"), F.sum("c").alias("c")).where("c > 1")
    top = materialize(top.select("h", F.col("top.fp").alias("top")), "tops")
    # sets that link share most of their bins' minima; what shares fewer is left to the join proper
    hit = e.select("fp", "size", "h").join(top, "h").where("fp <> top").groupBy("fp", "top").agg(F.count("*").alias("c"), F.min("size").alias("size")).where("2 * c >= size")
    return hit.groupBy("fp").agg(F.max(F.struct("c", "top")).alias("m")).select(F.col("m.top").alias("a"), F.col("fp").alias("b"))


def candidates(members: DataFrame, comp: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes of different components that share enough of their prefixes.

    First only (hash, component) pairs move, to find the hashes that several components have; a filter of a
    fixed size on these thins the prefixes out before the postings move.
    """
    spark = members.sparkSession
    one = members.where("fp is not null").groupBy("fp").agg(F.min(F.struct("n", "matches", "prefix")).alias("x")).select("fp", "x.*")
    c = one.join(comp.select(F.col("node").alias("fp"), "comp"), "fp", "left").withColumn("id", F.monotonically_increasing_id())
    named = materialize(c, "prefixes")
    # from here on classes and components are numbers: a component is the least of its classes, without one a class is its own
    own = named.where("comp is not null").groupBy("comp").agg(F.min("id").alias("of"))
    columns = ["id", "of", "n", "matches", "prefix"]
    alone = named.where("comp is null").withColumn("of", F.col("id")).select(*columns)  # no join: nulls would meet in one task
    c = materialize(named.where("comp is not null").join(own, "comp").select(*columns).union(alone), "numbered")
    names = materialize(named.select("id", "fp"), "names")
    discard(named)
    p = c.select(F.col("of").alias("c"), F.explode("prefix").alias("h"))
    mixed = materialize(p.groupBy("h").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("h"), "mixed")
    shared = spark.sparkContext.broadcast(bounded_filter(mixed.select(F.col("h").alias("v"))))
    buckets = c.withColumn("at", F.transform("prefix", lambda h: F.xxhash64(h)))

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("prefix")
            hit = in_filter(shared.value, batch.column("at").flatten().to_numpy())
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(batch.num_rows), sizes)
            pos = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(row[hit])), pa.array(pos[hit].astype(np.int32)), lists.flatten().filter(pa.array(hit))], ["id", "pos", "h"])

    p = buckets.select("id", "prefix", "at").mapInArrow(thin, "id long, pos int, h long").join(mixed, "h", "left_semi")
    # A pair of least match count l shares l shingles before place n - alpha + l of both: so this one and the l-th shared
    # one lie before it, which bounds alpha, and with it the partner's size.  What has no possible partner goes.
    # Sizes fall into steps of ratio 100 / percent: the larger of a pair, x, looks into its own step and the one below.
    step = lambda n: F.floor(F.log(n.cast("double")) / float(np.log(100 / percent))).cast("int")
    least_n = F.greatest(F.lit(1), F.ceil(F.col("n") * percent / 100))

    def possible(p: DataFrame) -> DataFrame:
        """Postings with an array of the class's places: those with a possible partner, and the largest one's size as `most`."""
        p = p.withColumn("alpha", F.col("n") - 1 + F.expr("array_max(transform(slice(places, 1, matches), (place, i) -> i + 1 - greatest(pos, place)))"))
        p = p.withColumn("most", F.least(F.col("n"), F.expr(f"(alpha * {100 + percent}) div {percent}") - F.col("n")))
        p = p.where((F.col("most") >= least_n) & (F.col("alpha") >= least_n))
        return p.withColumn("smaller", F.col("alpha") >= F.ceil(F.col("n") * 2 * percent / (100 + percent)))  # of one size at best

    one = ["id", "of", "n", "matches"]
    about = c.select(*one)  # postings move without what belongs to their class
    own = p.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "h"))).alias("s")).join(about, "id")
    p = own.select(*one, F.col("s.pos").alias("places"), F.explode("s").alias("s")).select(*one, "places", "s.*")
    p = postings = materialize(possible(p).drop("places", "alpha"), "postings")
    discard(mixed)
    release(spark)
    # only shingles that two components have within the sizes of a possible pair count
    x = p.select("id", "of", "pos", "h", F.explode(F.sequence(step(least_n), step(F.col("most")))).alias("step"))
    y = p.where("smaller").select("id", "of", "pos", "h", step(F.col("n")).alias("step"))
    ends = lambda df, tag: df.groupBy("h", "step").agg(F.min("of").alias(f"lo{tag}"), F.max("of").alias(f"hi{tag}"))
    keys = materialize(ends(x, "x").join(ends(y, "y"), ["h", "step"]).where("not (lox = hix and loy = hiy and lox = loy)").select("h", "step"), "keys")
    kept = some = materialize(x.drop("of").withColumn("as_x", F.lit(True)).union(y.drop("of").withColumn("as_x", F.lit(False))).join(keys, ["h", "step"]), "kept")
    discard(postings, keys)
    release(spark)
    # each class with what is left of its prefix: places in it, and low bits of the shingles
    own = kept.groupBy("id").agg(F.array_sort(F.collect_set(F.struct("pos", "h"))).alias("s")).join(about, "id")
    own = own.select(*one, F.col("s.pos").alias("places"), F.transform("s", lambda s: s["h"].bitwiseAND(0x7FFFFFFF).cast("int")).alias("low"))
    own = materialize(own.withColumn("spare", F.size("low") - F.size(F.array_distinct("low"))), "own")
    kept = possible(kept.join(own.drop("low", "spare"), "id")).where(F.when(F.col("as_x"), F.col("step") <= step(F.col("most"))).otherwise(F.col("smaller")))
    kept = materialize(kept.select("id", "of", "h", "step", "pos", "as_x"), "kept")
    discard(some, c)
    release(spark)
    large = kept.select("id", "of").distinct().groupBy("of").agg(F.count("*").alias("c")).where(F.col("c") > CHUNK).select("of", F.col("of").alias("g"))
    large = materialize(large, "large")

    def lists(df: DataFrame, tag: str) -> DataFrame:
        """Lists of bounded size: of one large component, or of all others."""
        df = df.join(large, "of", "left").withColumn("g", F.coalesce("g", F.lit(-1).cast("long")))
        sizes = df.groupBy("h", "step", "g").agg(F.ceil(F.count("*") / CHUNK).alias("chunks")).where("chunks > 1")
        df = df.join(sizes, ["h", "step", "g"], "left").withColumn("chunk", F.expr("pmod(xxhash64(id), coalesce(chunks, 1))"))
        # what a class shares is joined on here, so it only moves with the list that needs it
        df = df.select("id", "h", "step", "g", "chunk", "pos").join(own, "id")
        item = F.struct("id", "of", "n", "matches", "pos", "places", "low", "spare")
        return materialize(df.groupBy("h", "step", F.col("g").alias(f"g{tag}"), "chunk").agg(F.collect_list(item).alias(f"m{tag}")).drop("chunk"), f"lists{tag}")

    def fits(x: Column, y: Column) -> Column:
        alpha = F.ceil(percent * (x["n"] + y["n"]) / (100 + percent))
        least = F.least(x["matches"], y["matches"])
        larger = (y["n"] < x["n"]) | ((y["n"] == x["n"]) & (y["id"] < x["id"]))
        end = lambda z: z["n"] - alpha + least
        early = lambda z: F.greatest(z["pos"], F.coalesce(F.get(z["places"], least - 1), F.lit(1 << 30))) < end(z)
        within = lambda z: F.slice(z["low"], 1, F.size(F.filter(z["places"], lambda at: at < end(z))))
        # low bits of the shingles: those that share theirs with another count once, so their number is added; what that lets through too much is verified
        common = F.size(F.array_intersect(within(x), within(y))) + x["spare"]
        return (x["of"] != y["of"]) & larger & (100 * y["n"] >= percent * x["n"]) & early(x) & early(y) & (common >= least)

    found = F.flatten(F.transform("mx", lambda x: F.transform(F.filter("my", lambda y: fits(x, y)), lambda y: F.struct(x["id"].alias("a"), y["id"].alias("b")))))

    def meet(some: DataFrame) -> DataFrame:
        """Pairs (a, b) that meet by these shingles; the lists, which carry much, are gone when they are written."""
        left = lists(some.where("as_x"), "x")
        release(spark)
        right = lists(some.where("not as_x"), "y")
        release(spark)
        met = left.join(right, ["h", "step"]).where((F.col("gx") != F.col("gy")) | (F.col("gx") == -1))
        pairs = materialize(met.select(F.explode(found).alias("m")).select("m.a", "m.b").distinct(), "numbers")
        discard(left, right)
        release(spark)
        return pairs

    # lists of each shingle are made and met in one round, so only a round's share of them lies on disk
    rounds = min(ROUNDS, 1 + kept.count() // ROUND_ROWS)
    pairs = reduce(DataFrame.union, [meet(kept.where(F.pmod("h", F.lit(rounds)) == r)) for r in range(rounds)]).distinct()
    of = lambda c: names.select(F.col("id").alias(c), F.col("fp").alias(f"fp{c}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").select(F.col("fpa").alias("a"), F.col("fpb").alias("b"))


def linked(x: list[np.ndarray], y: list[np.ndarray], percent: int) -> np.ndarray:
    """Which sets of x link with which of y, as a matrix."""
    sizes = [np.array([len(s) for s in z], np.int64) for z in (x, y)]
    values, column = np.unique(np.concatenate([*x, *y]), return_inverse=True)
    row = np.repeat(np.arange(len(x) + len(y)), np.concatenate(sizes))
    some = np.bincount(column, minlength=len(values)) > 1  # what one set holds alone is in no intersection
    row, column = row[some[column]], (np.cumsum(some) - 1)[column[some[column]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    shared = np.zeros((len(x), len(y)), np.int64)
    for first in range(0, int(some.sum()), COLUMNS):
        a, b = np.searchsorted(column, [first, first + COLUMNS])
        has = np.zeros((len(x) + len(y), COLUMNS), np.float32)
        has[row[a:b], column[a:b] - first] = 1
        shared += (has[: len(x)] @ has[len(x) :].T).astype(np.int64)
    return 100 * shared >= percent * (sizes[0][:, None] + sizes[1][None, :] - shared)


def count_links(comp: DataFrame, members: DataFrame, found: DataFrame, k: int, percent: int) -> DataFrame:
    """(fp, n_links): of each class of the components (node, comp), with how many others it links; found: the texts."""
    spark = comp.sparkSession
    n = members.where("fp is not null").groupBy("fp").agg(F.min("n").alias("n"))
    step = F.floor(F.log(F.col("n").cast("double")) / float(np.log(SIZE_STEP))).cast("int")
    nodes = materialize(comp.withColumnRenamed("node", "fp").join(n, "fp").withColumn("step", step), "nodes")
    whole = nodes.groupBy("comp").agg(F.count("*").alias("c"), F.sum("n").alias("items"))
    two = nodes.join(whole.where("c = 2"), "comp").select("fp", F.lit(1).cast("long").alias("n_links"))
    # a small component is one block, a large one is dealt by steps of size and then by hash
    small = (F.col("c") <= BLOCK) & (F.col("items") <= BLOCK_ITEMS)
    more = nodes.join(whole.where("c > 2").select("comp", small.alias("small")), "comp")
    more = more.withColumn("step", F.when(F.col("small"), -1).otherwise(F.col("step")))
    per = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(F.lit(BLOCK_ITEMS) / F.max("n"))))
    dealt = materialize(more.groupBy("comp", "step").agg(F.when(F.col("step") < 0, 1).otherwise(F.ceil(F.count("*") / per)).alias("salts"), F.min("n").alias("least"), F.max("n").alias("most")), "dealt")
    more = more.join(dealt.select("comp", "step", "salts"), ["comp", "step"]).withColumn("salt", F.expr("pmod(xxhash64(fp), salts)"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 512) for b in batches for i in range(0, b.num_rows, 512)):
            raw = [shingle_set(t, k).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("comp", "step", "salt", "fp")), pa.array(raw, pa.binary())], ["comp", "step", "salt", "fp", "s"])

    with small_batches(spark):
        rows = more.join(found, "fp").select("comp", "step", "salt", "fp", "text").mapInArrow(sets, "comp binary, step int, salt long, fp binary, s binary")
        blocks = materialize(rows.groupBy("comp", "step", "salt").agg(F.collect_list(F.struct("fp", "s")).alias("m")), "blocks")
    release(spark)

    def given(members) -> tuple[list[bytes], list[np.ndarray]]:
        return [m["fp"] for m in members], [np.frombuffer(m["s"], np.uint64) for m in members]

    def counts(fp: list[bytes], c: np.ndarray) -> pa.RecordBatch:
        some = np.flatnonzero(c)
        return pa.RecordBatch.from_arrays([pa.array([fp[i] for i in some], pa.binary()), pa.array(c[some].astype(np.int64))], ["fp", "n_links"])

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                fp, s = given(batch.column("m")[i].as_py())
                yield counts(fp, linked(s, s, percent).sum(1) - 1)  # each set links with itself

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (fx, x), (fy, y) = given(batch.column("mx")[i].as_py()), given(batch.column("my")[i].as_py())
                hit = linked(x, y, percent)
                yield counts(fx, hit.sum(1))
                yield counts(fy, hit.sum(0))

    of = lambda c: dealt.where("step >= 0").select("comp", *(F.col(x).alias(x + c) for x in ("step", "least", "most")), F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt" + c))
    meet = of("x").join(of("y"), "comp").where("(stepx > stepy or stepx = stepy and saltx > salty)").where(100 * F.col("mosty") >= percent * F.col("leastx"))
    meet = materialize(meet.select("comp", "stepx", "saltx", "stepy", "salty"), "meet")
    block = lambda c: blocks.select("comp", *(F.col(x).alias(x + c) for x in ("step", "salt", "m")))
    meet = meet.join(block("x"), ["comp", "stepx", "saltx"]).join(block("y"), ["comp", "stepy", "salty"])
    with small_batches(spark, 8):  # blocks are of some MB
        found = materialize(blocks.select("m").mapInArrow(within, "fp binary, n_links long").union(meet.select("mx", "my").mapInArrow(across, "fp binary, n_links long")), "counts")
    return two.union(found).groupBy("fp").agg(F.sum("n_links").alias("n_links"))


def join(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, count: bool = True) -> DataFrame:
    """doc_id, n_shingles, component_id, and class and group (None without words) and, to count them, n_links: all links of its class with others."""
    docs = docs.select("doc_id", "text")
    members = materialize(describe(docs, k, percent), "members")
    with_fp = members.where("fp is not null")
    classes = materialize(with_fp.groupBy("fp").agg(F.min(locate(members)).alias("locate")), "classes")
    pairs = materialize(first_links(members), "pairs")
    found = texts_of(pairs, docs, classes, k)
    links = materialize(verified(pairs, found, k, percent), "links")
    release(docs.sparkSession)
    comp = components(links)
    release(docs.sparkSession)
    pairs = materialize(candidates(members, comp, percent), "pairs")
    # prefixes and minima have done their part
    whole, members = members, materialize(members.select("doc_id", "fp", "n"), "members")
    with_fp = members.where("fp is not null")
    discard(whole)
    release(docs.sparkSession)
    more = texts_of(pairs, docs, classes, k)
    links = materialize(links.union(verified(pairs, more, k, percent)), "alllinks")
    release(docs.sparkSession)
    comp = components(links)
    release(docs.sparkSession)
    label = classes.select("fp", "locate").join(comp.withColumnRenamed("node", "fp"), "fp", "left")
    label = label.withColumn("comp", F.coalesce("comp", "fp"))
    least = with_fp.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("d"))
    label = label.join(least, "fp", "left")
    ids = label.groupBy("comp").agg(F.min("d").alias("component_id"))
    label = label.join(ids, "comp").select("fp", "comp", "component_id")
    if count:
        texts = found.union(more.join(found, "fp", "left_anti"))
        label = label.join(count_links(comp, members, texts, k, percent), "fp", "left")
    label = materialize(label, "labels")
    out = members.select("doc_id", "n", "fp").join(label, "fp", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.col("fp").alias("class"), F.col("comp").alias("group"), *[F.coalesce("n_links", F.lit(0)).alias("n_links")] * count)


def keep_one(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """One row of each component, that of the smallest doc_id; rows without words all stay.

    Rows that share a doc_id (or have none) are told apart by their sets.
    """
    found = materialize(join(docs, k, percent, count=False), "joined")
    of_words = found.where("class is not null")
    stay = of_words.groupBy("group").agg(F.min(F.struct("doc_id", "class")).alias("m")).select(F.col("m.doc_id").alias("id"), F.col("m.class").alias("fp"))
    stay = materialize(stay, "stay")
    go = of_words.join(stay, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("class") == F.col("fp")), "left_anti").select(F.col("doc_id").alias("id"))
    repeated = materialize(found.groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("c")).where("c > 1 or id is null").select("id"), "repeated")
    # names that no column of the documents has
    id_, class_ = fresh(docs, "id"), fresh(docs, "class")
    of_id = lambda df: df.select(F.col("id").alias(id_))
    same = F.col("doc_id").eqNullSafe(F.col(id_))
    out = docs.join(of_id(materialize(go.union(repeated).distinct(), "go")), same, "left_anti")
    if not repeated.take(1):
        return out

    @F.pandas_udf("binary")
    def class_of(texts: pd.Series) -> pd.Series:
        return pd.Series([class_key(shingle_set(t, k)) for t in texts], dtype=object)

    rows = docs.join(of_id(repeated), same, "left_semi").withColumn(class_, class_of(F.col("text")))
    fp = fresh(docs, "fp")
    one = rows.where(F.col(class_).isNotNull()).join(stay.select(F.col("id").alias(id_), F.col("fp").alias(fp)), same & (F.col(class_) == F.col(fp)), "left_semi").dropDuplicates(["doc_id", class_])
    return out.unionByName(one.drop(class_)).unionByName(rows.where(F.col(class_).isNull()).drop(class_))


def query(spark, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id", "n_links")


#: All pairs of classes that share a shingle, and what they reach; for small tables.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_sort(CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d),
k AS (SELECT doc_id, len(s) AS n, md5(array_to_string(s, chr(10))) AS c, s FROM s), cl AS (SELECT c, any_value(n) AS n, min(doc_id) AS d, any_value(s) AS s FROM k WHERE n > 0 GROUP BY c),
e AS (SELECT c, unnest(s) AS x FROM cl), i AS (SELECT a.c AS a, b.c AS b, count(*) AS i FROM e a JOIN e b ON a.x = b.x AND a.c < b.c GROUP BY 1, 2),
l AS (SELECT a, b FROM i JOIN cl p ON p.c = a JOIN cl q ON q.c = b WHERE 100 * i >= 90 * (p.n + q.n - i)), o AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(c, m) AS (SELECT c, c FROM cl UNION SELECT r.c, o.b FROM r JOIN o ON r.m = o.a), t AS (SELECT r.c, min(cl.d) AS component_id FROM r JOIN cl ON cl.c = r.m GROUP BY 1), n AS (SELECT a AS c, count(*) AS n_links FROM o GROUP BY 1)
SELECT doc_id, n AS n_shingles, coalesce(component_id, doc_id) AS component_id, coalesce(n_links, 0) AS n_links FROM k LEFT JOIN t ON t.c = k.c AND k.n > 0 LEFT JOIN n ON n.c = k.c AND k.n > 0
"""
