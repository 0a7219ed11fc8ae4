"""SentencePiece encoding and decoding: a relational lattice, folded by a higher-order aggregate.

The text is "▁" + text with every space written as ▁, so nothing is lost.  It
is cut into units: all ▁ and the letters, or the other characters, behind them; a
place that a piece of the vocabulary reaches over is no cut, so the units' best paths are that of
the text.  The distinct units of all texts become rows, their substrings of the lengths that pieces with such an end
have are exploded and equi-joined to the piece table (broadcast: its
size is that of the vocabulary), the edges are grouped by unit, and an
aggregate() over the edges in order of their ends folds the Viterbi path: the
highest sum of piece scores, ties to the longer last piece; edges and nodes are longs where their fields fit.  A character that no
piece covers is an edge of the lowest score less 10; it becomes the vocabulary's
byte pieces.

The edges of a unit of more than STRETCH characters are grouped by stretches of it.  A stretch can only be entered at the nodes
that its first edges come from, the longest piece's length at most: one fold from each gives what it adds up to
each of its last nodes, an aggregate() over the unit's stretches then gives the scores that every stretch is entered with, a second
fold from those the paths, and an aggregate() from the last stretch back which of them make up the unit's.
Scores of the vocabulary are whole numbers, so it doesn't matter in which order they are added.

The units' paths are written as sorted hash arrays, which workers
memory-map to put documents together, by numpy over a slice of texts at a time; only units move between tasks, never
texts.  A unit is found by 128 bits of its characters: 64 place it, the others are compared, and one that fails is an error.

decode() is the reverse: pieces and bytes joined, ▁ written as a space, the first dropped.

Texts that hold ▁ itself come back with a space there, and round_trip is false for them.  Defined results: null or empty text has no ids;
repeated rows give repeated results; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize, mix, new_folder, settings, small_batches
from .files import mapped, write_bytes

SPACE, STRETCH, TAIL, CACHE, SLICE, CHARS = "▁", 256, 3, 200_000, 256, 1 << 20
UNIT = re.compile(rf"{SPACE}*(?:[^\W\d_]+|(?:(?!{SPACE})[\W\d_])+)|{SPACE}+")


LETTER = re.compile(r"[^\W\d_]")


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@lru_cache(2)
def vocabulary(path: str) -> tuple[list[str], list[float], list[int], list[bool]]:
    """Pieces, scores, the ids of the 256 byte pieces, and which pieces the lattice uses."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    scores = [sp.get_score(i) for i in range(len(pieces))]
    usable = [not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)) for i in range(len(pieces))]
    return pieces, scores, [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], usable


@lru_cache(2)
def joints(path: str) -> frozenset[str]:
    """The pairs of characters that some piece holds where UNIT cuts: texts aren't cut there."""
    pieces, _, _, usable = vocabulary(path)
    parts = [UNIT.findall(p) for p, u in zip(pieces, usable, strict=True) if u]
    return frozenset(a[-1] + b[0] for x in parts for a, b in zip(x, x[1:]))


def units_of(text: str | None, path: str | None = None) -> list[str]:
    out, over = [], joints(path or model_path())
    for unit in UNIT.findall(SPACE + text.replace(" ", SPACE)) if text else []:
        if out and out[-1][-1] + unit[0] in over:
            out[-1] += unit
        else:
            out.append(unit)
    return out


@lru_cache(1)
def letters() -> np.ndarray:
    """Of every code point, 1 for a letter, 2 for ▁, else 0, as in UNIT."""
    out = np.frombuffer("".join(map(chr, range(0x110000))).encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = np.fromiter((bool(LETTER.match(chr(c))) for c in out.tolist()), np.uint8, len(out))
    kind[ord(SPACE)] = 2
    return kind


class Units:
    """The units of some texts, one after the other, without a string for each.

    start and end are places in `text`, all texts behind their first ▁; first[i] is the number of the first unit of
    text i; key holds two independent 64-bit hashes of each unit.
    """

    def __init__(self, texts: list[str], kind: np.ndarray, over: frozenset[str]):
        self.text = "".join(SPACE + t for t in texts if t).replace(" ", SPACE)
        code = np.frombuffer(self.text.encode("utf-32-le"), np.uint32)
        size = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
        cls = kind[code]
        cut = np.zeros(len(code) + 1, bool)
        # ▁ opens a unit but behind another ▁; letters and others part, but behind ▁
        cut[1:-1] = np.where(cls[1:] == 2, cls[:-1] != 2, (cls[:-1] != 2) & (cls[1:] != cls[:-1]))
        for a, b in over:
            at = np.flatnonzero(cut[1:-1] & (code[1:] == ord(b)))
            cut[1 + at[code[at] == ord(a)]] = False
        cut[np.append(0, np.cumsum(size))] = True
        places = np.flatnonzero(cut)
        self.start, self.end = places[:-1], places[1:]
        self.first = np.searchsorted(self.start, np.append(0, np.cumsum(size)))
        self.key = hashes(code, self.start, self.end)

    def __getitem__(self, i: int) -> str:
        return self.text[self.start[i] : self.end[i]]


def hashes(code: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each run code[start:end]; the runs lie one behind the other."""
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    at = np.arange(len(code)) - np.repeat(start, end - start)
    out = []
    for factor, add in ((0x9FB21C651E98DF25, 0x2545F4914F6CDD1D), (0xD1B54A32D192ED03, 0xA0761D6478BD642F)):
        power = np.multiply.accumulate(np.full(int((end - start).max()), factor, np.uint64))
        value = (code.astype(np.uint64) + np.uint64(1)) * np.uint64(add)
        out.append(mix(np.add.reduceat((value ^ (value >> np.uint64(29))) * power[at], start)))
    return tuple(out)


def hashes_of(units: list[str]) -> tuple[np.ndarray, np.ndarray]:
    ends = np.cumsum([len(u) for u in units], dtype=np.int64)
    return hashes(np.frombuffer("".join(units).encode("utf-32-le"), np.uint32), np.append(0, ends[:-1])[: len(units)], ends)


def slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Rows and their texts, up to SLICE of them or about CHARS characters at a time."""
    for batch in batches:
        first, size = 0, 0
        for i, n in enumerate(pc.fill_null(pc.utf8_length(batch.column(column)), 0).to_pylist() + [CHARS + 1]):
            if i > first and (size + n > CHARS or i - first == SLICE):
                rows = batch.slice(first, i - first)
                yield rows, [t or "" for t in rows.column(column).to_pylist()]
                first, size = i, 0
            size += n


def distinct_units(docs: DataFrame, path: str) -> DataFrame:
    """The distinct units of the texts."""
    shared = docs.sparkSession.sparkContext.broadcast((letters(), joints(path)))  # a byte a code point; pairs out of pieces

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for _, texts in slices(batches, 0):
            units = Units(texts, *shared.value)
            key, at = np.unique(units.key[0], return_index=True)
            # two units of one hash and slice would be one here, and miss the other's path, which the lookup refuses
            fresh = [i for k, i in zip(key.tolist(), at.tolist(), strict=True) if k not in seen]
            if len(seen) > 5 * CACHE:
                seen.clear()
            seen.update(units.key[0][fresh].tolist())
            yield pa.RecordBatch.from_arrays([pa.array([units[i] for i in fresh], pa.string())], ["unit"])

    return docs.select("text").mapInArrow(work, "unit string").distinct()


def piece_table(spark, path: str) -> DataFrame:
    pieces, scores, _, usable = vocabulary(path)
    rows = [(p, i, float(s)) for i, (p, s, u) in enumerate(zip(pieces, scores, usable, strict=True)) if u]
    return spark.createDataFrame(pa.table({"piece": [r[0] for r in rows], "id": pa.array([r[1] for r in rows], pa.int32()), "score": [r[2] for r in rows]}))


def length_table(pieces: DataFrame) -> DataFrame:
    """(tail, lengths): the lengths, in order, of the pieces that end with these TAIL characters; bounded by the vocabulary."""
    lengths = F.sort_array(F.collect_set(F.length("piece")))
    return pieces.where(F.length("piece") >= TAIL).groupBy(F.expr(f"right(piece, {TAIL})").alias("tail")).agg(lengths.alias("lengths"))


def edges_of(parts: DataFrame, pieces: DataFrame) -> DataFrame:
    """The edges of each part that end behind its first `before` characters, a row each: the other columns, e, n and the columns of the piece from e - n to e, null for a character that is none."""
    keys = [c for c in parts.columns if c != "part"]
    short = F.array(*(F.lit(n) for n in range(1, TAIL)))
    e = parts.select("*", F.explode(F.sequence(F.col("before") + 1, F.length("part"))).alias("e")).withColumn("tail", F.expr(f"substring(part, greatest(1, e - {TAIL - 1}), least(e, {TAIL}))"))
    # edges are made in the order in which the fold takes them, so that sorting them finds them sorted
    e = e.join(F.broadcast(length_table(pieces)), "tail", "left").select(*keys, "part", "e", F.explode(F.when(F.isnull("lengths"), short).otherwise(F.concat(short, "lengths"))).alias("n")).where("n <= e")
    e = e.withColumn("piece", F.expr("substring(part, e - n + 1, n)")).join(F.broadcast(pieces.withColumn("known", F.lit(True))), "piece", "left")
    return e.where(F.col("known").isNotNull() | (F.col("n") == 1)).drop("part", "piece", "tail", "known")


def lattice(parts: DataFrame, pieces: DataFrame, unknown: float) -> DataFrame:
    """The edges of each part as one array: the other columns, and edges (e, n, id, score) from e - n to e."""
    keys = [c for c in parts.columns if c != "part"]
    e = edges_of(parts, pieces)
    edge = F.struct("e", "n", F.coalesce("id", F.lit(-1)).alias("id"), F.coalesce("score", F.lit(unknown)).alias("score"))
    return e.groupBy(*keys).agg(F.sort_array(F.collect_list(edge)).alias("edges"))


def fold(entry: Column) -> Column:
    """Every node of a part: the score of the best way there by `edges` from the nodes 0 .. before, whose scores entry gives; its last edge's n and id."""
    node = lambda score, n, i: F.struct(score.alias("score"), n.alias("n"), i.alias("id"))
    state = lambda done, cur: F.struct(done.alias("done"), cur.alias("cur"))
    start = F.transform(entry, lambda score: node(score, F.lit(0), F.lit(-1)))

    def step(acc, x):
        # every node has an edge of one character, its first: it closes the node before, and `cur` is the best so far at its own; longer ones win ties
        done, cur = acc["done"], acc["cur"]
        come = F.get(done, x["e"] - x["n"])["score"] + x["score"]
        longer = F.when(come >= cur["score"], state(done, node(come, x["n"], x["id"]))).otherwise(acc)
        return F.when(x["n"] == 1, state(F.concat(done, F.array(cur)), node(cur["score"] + x["score"], x["n"], x["id"]))).otherwise(longer)

    return F.aggregate("edges", state(F.slice(start, F.lit(1), F.col("before")), F.get(start, F.col("before"))), step, lambda acc: F.concat(acc["done"], F.array(acc["cur"])))


def way(end: Column) -> Column:
    """The way to a node of fold()'s `nodes`: (at, ids), the node of 0 .. before that it comes from and its ids."""
    state = lambda at, ids: F.struct(at.alias("at"), ids.alias("ids"))

    def step(acc, i):
        x = F.get("nodes", i)
        return F.when(i == acc["at"], state(i - x["n"], F.concat(acc["ids"], F.array(x["id"])))).otherwise(acc)

    back = F.when(end > F.col("before"), F.sequence(end, F.col("before") + 1, F.lit(-1))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(back, state(end, F.array().cast("array<int>")), step, lambda acc: state(acc["at"], F.reverse(acc["ids"])))


def packs(pieces: DataFrame, unknown: float) -> bool:
    """Whether edges of these pieces, and the scores of units up to STRETCH characters, fit into longs: scores are whole numbers up to 0, lengths and ids small."""
    whole = (F.col("score") == F.floor("score")) & (F.col("score") <= 0) & (F.length("piece") < 32) & F.col("id").between(0, 0xFFFE)
    return -unknown < 1 << 31 and unknown == int(unknown) and pieces.where(~whole).isEmpty() and STRETCH < 1 << 10


def packed_viterbi(parts: DataFrame, pieces: DataFrame, unknown: float) -> DataFrame:
    """(unit, ids) of the parts (unit, part): the same paths by longs.

    From the low bits up, a node holds its last edge's id plus 1 (16 bits), 31 less that edge's length (5 bits), and its score, turned
    positive: the least of the ways to a node is the best one, the longer last edge winning ties.  An edge holds the same, its score in
    31 bits, and in the 10 bits above them its end.
    """
    cost = lambda score, n, i: F.shiftleft((-score).cast("long"), 21) + F.shiftleft((31 - n).cast("long"), 16) + i + 1
    table = pieces.select("piece", cost(F.col("score"), F.length("piece"), F.col("id")).alias("cost"))
    edge = F.shiftleft(F.col("e").cast("long"), 52) + F.coalesce("cost", cost(F.lit(unknown), F.lit(1), F.lit(-1)))
    edges = edges_of(parts, table).groupBy("unit").agg(F.sort_array(F.collect_list(edge)).alias("edges"))
    state = lambda done, cur: F.struct(done.alias("done"), cur.alias("cur"))
    less = lambda x: (F.shiftright(x, 16).bitwiseAND(31) - 31).cast("int")  # noqa: E731  minus the last edge's length
    come = lambda source, x: source.bitwiseAND(-(1 << 21)) + x.bitwiseAND((1 << 52) - 1)

    def step(acc, x):
        # the first edge to a node closes the one before; `cur` is the best so far at its own
        done, cur = acc["done"], acc["cur"]
        first = state(F.concat(done, F.array(cur)), come(F.when(less(x) == -1, cur).otherwise(F.get(done, F.size(done) + less(x) + 1)), x))
        return F.when(F.shiftright(x, 52) > F.size(done), first).otherwise(state(done, F.least(cur, come(F.element_at(done, less(x)), x))))

    zero = state(F.array().cast("array<bigint>"), F.lit(0).cast("long"))
    nodes = edges.select("unit", F.aggregate("edges", zero, step, lambda acc: F.concat(acc["done"], F.array(acc["cur"]))).alias("nodes"))
    way = lambda at, ids: F.struct(at.alias("at"), ids.alias("ids"))

    def back(acc, i):
        x = F.get("nodes", i)
        return F.when(i == acc["at"], way(i + less(x), F.concat(F.array((x.bitwiseAND(0xFFFF) - 1).cast("int")), acc["ids"]))).otherwise(acc)

    end = F.size("nodes") - 1
    return nodes.select("unit", F.aggregate(F.sequence(end, F.lit(1), F.lit(-1)), way(end, F.array().cast("array<int>")), back, lambda acc: acc["ids"]).alias("ids"))


def viterbi(units: DataFrame, pieces: DataFrame, unknown: float) -> DataFrame:
    """(unit, ids) of units up to STRETCH characters: the best path; an id of -1 for each character that no piece covers."""
    # dealt by unit here, so that edges are grouped where they are made
    units = units.repartition(2 * int(units.sparkSession.conf.get("spark.sql.shuffle.partitions")), "unit")
    if packs(pieces, unknown):
        return packed_viterbi(units.select("unit", F.col("unit").alias("part"), F.lit(0).alias("before")), pieces, unknown)
    edges = lattice(units.select("unit", F.col("unit").alias("part"), F.lit(0).alias("before")), pieces, unknown)
    return edges.select("unit", "before", fold(F.array(F.lit(0.0))).alias("nodes")).select("unit", way(F.size("nodes") - 1)["ids"].alias("ids"))


def viterbi_of_long(units: DataFrame, pieces: DataFrame, unknown: float, longest: int, stretch: int = STRETCH) -> DataFrame:
    """viterbi() of units of any length, by stretches; a stretch is entered, and left, at `longest` nodes at most."""
    if stretch < longest:
        raise ValueError("a stretch is at least as long as the longest piece")
    units, back = units.select(F.sha2("unit", 256).alias("key"), "unit"), longest - 1
    parts = units.select("key", "unit", F.explode(F.expr(f"sequence(0, (length(unit) - 1) div {stretch})").cast("array<int>")).alias("k"))
    parts = parts.withColumn("before", F.when(F.col("k") == 0, 0).otherwise(back))
    parts = parts.select("key", "k", "before", F.expr(f"substring(unit, k * {stretch} - before + 1, {stretch} + before)").alias("part"))
    edges = materialize(lattice(parts.repartition(F.col("key"), F.col("k")), pieces, unknown), "stretches")
    last = F.sequence(F.greatest(F.lit(0), F.size("nodes") - longest), F.size("nodes") - 1)
    # what a stretch adds, from each node it can be entered at to each of its last ones
    starts = F.array_union(F.array("before"), F.transform(F.filter("edges", lambda x: x["e"] - x["n"] < F.col("before")), lambda x: x["e"] - x["n"]))
    only = F.transform(F.sequence(F.lit(0), F.col("before")), lambda j: F.when(j == F.col("i"), F.lit(0.0)).otherwise(F.lit(float("-inf"))))
    ways = edges.select("*", F.explode(starts).alias("i")).withColumn("nodes", fold(only))
    ways = ways.select("key", "k", "i", F.transform(last, lambda j: F.get("nodes", j)["score"]).alias("scores"))
    ways = ways.groupBy("key", "k").agg(F.collect_list(F.struct("i", "scores")).alias("ways"))

    def enter(acc, x):
        best = F.transform(F.sequence(F.lit(0), F.lit(back)), lambda j: F.array_max(F.transform(x["ways"], lambda w: F.get(acc["v"], w["i"]) + F.get(w["scores"], j))))
        return F.struct(best.alias("v"), F.concat(acc["all"], F.array(acc["v"])).alias("all"))

    zero = F.struct(F.array(F.lit(0.0)).alias("v"), F.array().cast("array<array<double>>").alias("all"))
    entered = ways.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("k", "ways"))).alias("parts"))
    entered = entered.select("key", F.posexplode(F.aggregate("parts", zero, enter, lambda acc: acc["all"])).alias("k", "v"))
    # the ways from there
    left = edges.join(entered, ["key", "k"]).withColumn("nodes", fold(F.col("v")))
    left = left.select("key", F.struct((-F.col("k")).alias("order"), F.transform(last, way).alias("ways")).alias("part"))

    def choose(acc, x):
        # the first is the last stretch, left at its last node; the others where the one behind them was entered
        taken = F.when(F.isnull(acc["at"]), F.element_at(x["ways"], -1)).otherwise(F.get(x["ways"], acc["at"]))
        return F.struct(taken["at"].alias("at"), F.concat(acc["all"], F.array(taken["ids"])).alias("all"))

    zero = F.struct(F.lit(None).cast("int").alias("at"), F.array().cast("array<array<int>>").alias("all"))
    found = left.groupBy("key").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    found = found.select("key", F.aggregate("parts", zero, choose, lambda acc: F.flatten(F.reverse(acc["all"]))).alias("ids"))
    return units.join(found, "key").select("unit", "ids")


def train_free_model(docs: DataFrame, path: str) -> list[tuple]:
    """Write the paths of all units of docs as sorted hash arrays; (shard, uri, n, n_ids) of each file."""
    spark = docs.sparkSession
    folder, shards = new_folder(spark, "pieces"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces, scores, bytes_at, usable = vocabulary(path)
    low = min(s for s, u in zip(scores, usable, strict=True) if u) - 10.0
    with small_batches(spark):
        units = materialize(distinct_units(docs, path), "units")
    table, is_long = piece_table(spark, path), F.length("unit") > STRETCH
    paths = viterbi(units.where(~is_long), table, float(low))
    if units.where(is_long).take(1):
        longest = max(len(p) for p, u in zip(pieces, usable, strict=True) if u)
        paths = paths.unionByName(viterbi_of_long(units.where(is_long), table, float(low), longest))

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units, ids = batch.column("unit").to_pylist(), batch.column("ids").to_pylist()
            for i, (unit, path) in enumerate(zip(units, ids, strict=True)):
                if -1 in path:  # the characters that no piece covers, as bytes
                    at, out = 0, []
                    for p in path:
                        out += [bytes_at[b] for b in unit[at].encode("utf-8")] if p < 0 else [p]
                        at += 1 if p < 0 else len(pieces[p])
                    ids[i] = out
            h, check = hashes_of(units)
            yield pa.RecordBatch.from_arrays([pa.array((h % np.uint64(shards)).astype(np.int32)), pa.array(h.view(np.int64)), pa.array(check.view(np.int64)), pa.array(ids, pa.list_(pa.int32()))], ["shard", "h", "check", "ids"])

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            shard = table.column("shard").to_numpy()
            for s in np.unique(shard):
                part = table.filter(pa.array(shard == s))
                h, check = (part.column(c).to_numpy().view(np.uint64) for c in ("h", "check"))
                part = part.take(pa.array(order := np.argsort(h)))
                ids = part.column("ids").combine_chunks()
                offsets = np.append(0, np.cumsum(ids.value_lengths().to_numpy())).astype(np.int64)
                flat = ids.flatten().to_numpy().astype(np.int32)
                uri = write_bytes(folder, f"units-{s}", [h[order].tobytes(), check[order].tobytes(), offsets.tobytes(), flat.tobytes()])
                yield pa.RecordBatch.from_arrays([pa.array([int(s)], pa.int32()), pa.array([uri]), pa.array([len(h)]), pa.array([len(flat)])], ["shard", "uri", "n", "n_ids"])

    keyed = paths.mapInArrow(key, "shard int, h long, check long, ids array<int>").repartition(shards, "shard")
    # a task's units are a bounded share, whose lists fit its memory: group them by hash rather than by a sort of all edges
    with settings(spark, spark__sql__objectHashAggregate__sortBased__fallbackThreshold=1_000_000):
        saved = materialize(keyed.mapInArrow(save, "shard int, uri string, n long, n_ids long"), "piece-files")
    return [tuple(r) for r in saved.collect()]  # names and sizes of the files


class Lookup:
    """Ids of units from the memory-mapped arrays."""

    def __init__(self, files, shards: int):
        self.shards, self.arrays = shards, {}
        for shard, uri, n, n_ids in files:
            raw = mapped(uri, np.uint8)
            self.arrays[shard] = raw[: 8 * n].view(np.uint64), raw[8 * n : 16 * n].view(np.uint64), raw[16 * n : 24 * n + 8].view(np.int64), raw[24 * n + 8 : 24 * n + 8 + 4 * n_ids].view(np.int32)

    def read(self, h: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all the units, one after the other, and how many each has; both hashes of a unit must be the entry's."""
        size, found = np.zeros(len(h), np.int64), []
        shard = (h % np.uint64(self.shards)).astype(np.int64)
        order = np.lexsort((h, shard))
        cuts = np.searchsorted(shard[order], np.arange(self.shards + 1))
        for s in np.flatnonzero(np.diff(cuts)):
            rows = order[cuts[s] : cuts[s + 1]]
            keys, checks, offsets, ids = self.arrays[int(s)]
            at = np.minimum(np.searchsorted(keys, h[rows]), len(keys) - 1)
            if (wrong := (keys[at] != h[rows]) | (checks[at] != check[rows])).any():
                raise KeyError(f"{int(wrong.sum())} units without a path")
            size[rows] = offsets[at + 1] - offsets[at]
            found.append(gathered(ids, offsets[at], size[rows]))
        # back in the order of the units
        start = np.zeros(len(h), np.int64)
        start[order] = np.cumsum(size[order]) - size[order]
        return gathered(np.concatenate(found) if found else np.zeros(0, np.int32), start, size), size

    def ids(self, units: Units) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the units in order, and how many each has; each different unit is looked up once."""
        h, at, inverse = np.unique(units.key[0], return_index=True, return_inverse=True)
        if (units.key[1][at][inverse] != units.key[1]).any():
            raise KeyError("two units of one hash")
        flat, size = self.read(h, units.key[1][at])
        return gathered(flat, (np.cumsum(size) - size)[inverse], size[inverse]), size[inverse]


def gathered(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """values[start : start + size] of each row, one after the other."""
    ends = np.cumsum(size)
    return values[np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]


_READY: list = []


def _lookup(files: tuple, shards: int) -> Lookup:
    """The last files' lookup, kept for the tasks of one worker process."""
    if not _READY or _READY[0] != (files, shards):
        _READY[:] = [(files, shards), Lookup(files, shards)]
    return _READY[1]


def spelled(raws: Iterable[bytes]) -> str:
    """The text of the bytes of one document's pieces."""
    return b"".join(raws).decode("utf-8", "replace").replace(SPACE, " ")[1:]


def decoded(ids: list[int], path: str) -> str:
    """The text of the ids of one document."""
    return spelled(map(_piece_bytes(path).__getitem__, ids))


@lru_cache(2)
def _piece_bytes(path: str) -> list[bytes]:
    pieces, _, bytes_at, _ = vocabulary(path)
    out = [p.encode("utf-8") for p in pieces]
    for b, i in enumerate(bytes_at):
        out[i] = bytes([b])
    return out


SCHEMA = "n_units long, n_pieces long, n_byte_pieces long, ids_crc32 long, round_trip boolean, ids array<int>"


def encode(docs: DataFrame, path: str | None = None, keep: tuple[str, ...] = ("doc_id",), ids: bool = True) -> DataFrame:
    """The columns `keep` of docs, and SCHEMA, without its ids if they aren't asked for; round_trip: decoding each row's ids gives the text again.

    A name of SCHEMA that `keep` has as well gets underscores before it.
    """
    spark, path = docs.sparkSession, path or model_path()
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    files = spark.sparkContext.broadcast(tuple(train_free_model(docs, path)))  # names of the files
    vocab = vocabulary(path)
    is_byte = np.zeros(len(vocab[0]), bool)
    is_byte[vocab[2]] = True
    shared = spark.sparkContext.broadcast((is_byte, letters(), joints(path), _piece_bytes(path)))  # the vocabulary, a byte a code point
    at, kept = len(keep), docs.select(*keep)
    own = [x.split() for x in SCHEMA.split(", ")][: None if ids else -1]
    names = [*kept.columns, *(fresh(kept, name) for name, _ in own)]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), *(f"`{name}` {t}" for name, (_, t) in zip(names[at:], own, strict=True))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_byte, kind, over, raws = shared.value
        look = _lookup(files.value, shards)
        for rows, texts in slices(batches, at):
            units = Units(texts, kind, over)
            flat, n = look.ids(units)
            ends = np.append(0, np.cumsum(n))[units.first[1:]]
            sizes = np.diff(np.append(0, ends))
            byte = np.append(0, np.cumsum(is_byte[flat]))
            places = list(zip((ends - sizes).tolist(), ends.tolist(), strict=True))
            pieces = list(map(raws.__getitem__, flat.tolist()))
            same = [spelled(pieces[a:b]) == t for (a, b), t in zip(places, texts, strict=True)]
            found = [flat[a:b].tobytes() for a, b in places]
            longs = (np.diff(units.first), sizes, byte[ends] - byte[ends - sizes], [zlib.crc32(x) for x in found])
            out = [*(rows.column(i) for i in range(at)), *(pa.array(x, pa.int64()) for x in longs), pa.array(same, pa.bool_())]
            if ids:
                out.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(flat)))
            yield pa.RecordBatch.from_arrays(out, names)

    return docs.select(*keep, F.col("text").alias(fresh(docs, "whole"))).mapInArrow(work, schema)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """The texts of ids: the other columns, and text."""
    path = path or model_path()
    raws = encoded.sparkSession.sparkContext.broadcast(_piece_bytes(path))
    others = [c for c in encoded.columns if c not in ("ids", "text")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
            texts = [spelled(map(raws.value.__getitem__, x or [])) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(texts, pa.string())], [*others, "text"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.select(*others).schema), "text string"])
    return encoded.select(*others, "ids").mapInArrow(work, schema)


def query(spark, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), ids=False)
