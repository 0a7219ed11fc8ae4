"""WIN-14, QU-14/16: who a text is about, word by word, with long dialogues scanned in blocks.

The state between two words is small: the actor that is spoken of, and the last and the previous referent.  Each word is
a function on the states, and so is each run of words: functions are composed, which can be done for all blocks at once and in any grouping.
So every block (a turn) becomes one table of states; tables of FAN neighbours are composed into one, level by level, until
a dialogue has one; then the levels are passed down again, each giving its parts the state that they begin in; then every block is
read with its own state, all at once.  No task holds more than FAN tables or one turn.

Rules: `markers` (word: actor) name an actor, those in `referents` become the last referent; `pronouns` mean the last referent, or the previous one
after a word of `objects` if the last is spoken of already; after a word of `passing` the pronoun alone does, and the actor before goes on.  A pronoun
without a referent means the default actor, as do separators and the start of a turn; referents go on.  Null texts are empty.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenquery.sources.stored import shared_folder

FAN = 64
TOKEN = re.compile(r"[^\s.,;:!?]+|[.,;:!?\n]")


@dataclass(frozen=True)
class Rules:
    default: str
    markers: dict[str, str]
    referents: frozenset[str]
    pronouns: frozenset[str] = frozenset()
    objects: frozenset[str] = frozenset()
    passing: frozenset[str] = frozenset()
    separators: frozenset[str] = frozenset(".;!?\n")
    asks: frozenset[str] = frozenset("?")
    actors: tuple[str, ...] = field(init=False)

    def __post_init__(self):
        object.__setattr__(self, "actors", (self.default, *sorted({*self.markers.values()} - {self.default})))

    def states(self) -> int:
        """(actor, last, previous), no referent after the actors."""
        return len(self.actors) * (len(self.actors) + 1) ** 2

    def split(self, state: int) -> tuple[int, int, int]:
        n = len(self.actors) + 1
        return state // (n * n), state // n % n, state % n

    def joined(self, actor: int, last: int, previous: int) -> int:
        n = len(self.actors) + 1
        return (actor * n + last) * n + previous

    def kind(self, word: str, before: str) -> tuple[str, int] | None:
        """What a word does, by itself and the word before it; None for nothing."""
        if word in self.separators:
            return ("separator", 0)
        if word in self.pronouns:
            return ("passing" if before in self.passing else "object" if before in self.objects else "pronoun", 0)
        if word in self.markers:
            return ("marker", self.actors.index(self.markers[word]))
        return None

    def step(self, kind: tuple[str, int], state: int) -> tuple[int, int]:
        """The actor of the word itself, and the state after it."""
        actor, last, previous = self.split(state)
        none, (name, named) = len(self.actors), kind
        if name == "separator":
            return 0, self.joined(0, last, previous)
        if name == "marker":
            if self.actors[named] in self.referents:
                last, previous = named, (previous if named == last else last)
            return named, self.joined(named, last, previous)
        meant = 0 if last == none else previous if name == "object" and actor == last and previous != none else last
        return meant, self.joined(actor if name == "passing" else meant, last, previous)

    def start(self) -> int:
        return self.joined(0, len(self.actors), len(self.actors))


def words(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


def table(rules: Rules, text: str | None, known: dict) -> np.ndarray:
    """Of every state before a turn the one after it; known: tables of the kinds that came before."""
    state = np.arange(rules.states(), dtype=np.uint16)
    before = "\n"
    for w in ["\n", *words(text)]:
        if kind := rules.kind(w, before):
            if kind not in known:
                known[kind] = np.array([rules.step(kind, s)[1] for s in range(rules.states())], np.uint16)
            state = known[kind][state]
        before = w
    return state


def read(rules: Rules, text: str | None, state: int) -> list[tuple[str, list[str], bool]]:
    """(actor, words, whether it asks) of the segments of a turn that begins in a state."""
    out: list[list] = []
    new, before, state = True, "\n", rules.step(("separator", 0), state)[1]
    for w in words(text):
        kind = rules.kind(w, before)
        actor, state = rules.step(kind, state) if kind else (rules.split(state)[0], state)
        before = w
        if w in rules.separators:
            if out and not new and w in rules.asks:
                out[-1][2] = True
            new = True
            continue
        if new or out[-1][0] != rules.actors[actor]:
            out.append([rules.actors[actor], [], False])
            new = False
        out[-1][1].append(w)
    return [tuple(x) for x in out]


def entries(turns: DataFrame, key: str, order: str, text: str, rules: Rules, fan: int = FAN) -> DataFrame:
    """(key, order, text, state): each turn with the state that it begins in; order: whole numbers from 0, one turn each."""
    spark = turns.sparkSession
    shared_folder(spark)
    names = ["k", "o", "t"]
    base = turns.select(F.col(key).alias("k"), F.col(order).cast("long").alias("o"), F.col(text).alias("t"))
    kind = base.schema["k"].dataType.simpleString()

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256)):
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("o"), pa.array([table(rules, t, known).tobytes() for t in batch.column("t").to_pylist()], pa.binary())], ["k", "o", "m"])

    levels = [base.mapInArrow(tables, f"k {kind}, o long, m binary").checkpoint()]
    most = levels[0].agg(F.max("o")).first()[0] or 0

    def composed(rows: pd.DataFrame) -> pd.DataFrame:
        state = np.arange(rules.states(), dtype=np.uint16)
        for m in rows.sort_values("o")["m"]:
            state = np.frombuffer(m, np.uint16)[state]
        return pd.DataFrame({"k": rows["k"].iloc[:1], "o": rows["o"].iloc[:1] // fan, "m": [state.tobytes()]})

    while most > 0:
        levels.append(levels[-1].groupBy("k", F.floor(F.col("o") / fan).alias("g")).applyInPandas(composed, f"k {kind}, o long, m binary").checkpoint())
        most //= fan

    def down(above: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        state, out = int(above["s"].iloc[0]), []
        rows = rows.sort_values("o")
        for m in rows["m"]:
            out.append(state)
            state = int(np.frombuffer(m, np.uint16)[state])
        return pd.DataFrame({"k": rows["k"], "o": rows["o"], "s": out})

    state = levels.pop().select("k", "o", F.lit(rules.start()).alias("s"))
    while levels:
        state = state.groupBy("k", "o").cogroup(levels.pop().groupBy("k", F.floor(F.col("o") / fan))).applyInPandas(down, f"k {kind}, o long, s int")
    met = base.join(state, (base["k"].eqNullSafe(state["k"])) & (base["o"] == state["o"])).select(*[base[n] for n in names], "s")
    return met.toDF(key, order, text, "state")


SEGMENTS = "segment int, actor string, words array<string>, asks boolean"


def segments(turns: DataFrame, key: str, order: str, text: str, rules: Rules, fan: int = FAN) -> DataFrame:
    """(key, order, segment, actor, words, asks) of all turns."""
    x = entries(turns, key, order, text, rules, fan)
    schema = f"`{key}` {x.schema[key].dataType.simpleString()}, `{order}` long, {SEGMENTS}"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256)):
            at, rows = [], []
            for i, (t, s) in enumerate(zip(batch.column(text).to_pylist(), batch.column("state").to_pylist(), strict=True)):
                found = read(rules, t, s)
                at += [i] * len(found)
                rows += [(n, *x) for n, x in enumerate(found)]
            number, actor, said, asks = zip(*rows, strict=True) if rows else ((),) * 4
            take = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(key).take(take), batch.column(order).take(take), pa.array(number, pa.int32()), pa.array(actor, pa.string()), pa.array(said, pa.list_(pa.string())), pa.array(asks, pa.bool_())],
                [key, order, "segment", "actor", "words", "asks"],
            )

    return x.mapInArrow(work, schema)


def model(found: DataFrame, key: str, order: str, rules: Rules) -> DataFrame:
    """QU-16: (key, target, actors): the actor of the last segment that asks (the default one if none does), and a record of every actor: segments, words, digest of what is said of it."""
    place = F.struct(F.col(order).alias("o"), "segment")
    turn = found.groupBy(key, "actor", order).agg(F.count("*").alias("n"), F.sum(F.size("words")).alias("w"), F.md5(F.concat_ws(" ", F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("segment", "words"))), lambda x: x["words"]))).cast("binary")).alias("d"))
    per = turn.groupBy(key, "actor").agg(F.sum("n").alias("segments"), F.sum("w").alias("words"), F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "d"))), lambda x: x["d"]), "").cast("binary")).alias("digest"))
    target = found.groupBy(key).agg(F.max_by("actor", F.when(F.col("asks"), place)).alias("asked"))
    record = per.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("actor", "segments", "words", "digest"))).alias("actors"))
    return record.join(target, key).select(key, F.coalesce("asked", F.lit(rules.default)).alias("target"), "actors")
