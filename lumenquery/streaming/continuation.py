"""QU-09/10: a dialogue that asks and is answered over many turns, as keyed state of a stream.

State of a key: its number of answered turns and a digest that chains them (a value), and the requests that wait for an answer with the time they
were asked at (a map).  A request is answered once, while it waits and isn't older than `ttl`; an answer to any other is stale; after `most` turns answers are
refused.  What is older than ttl expires: at the key's next event, or by an event-time timer once the watermark is past it, whichever comes
first, and once.  Events of a batch are taken in the order of their time and id.

The batch twin runs the same step over a whole key, so restarts and batches can be held against it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor

#: Of events (key, at, event_id, kind 'ask' or 'answer', request).
OUT = "key long, event_id long, request int, outcome string, turn int, digest string"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_store(spark: SparkSession):
    """The session's state store is PROVIDER while a stream starts."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, PROVIDER)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def millis(at: pd.Series) -> pd.Series:
    return at.astype("datetime64[ms]").astype("int64")


def step(state: tuple[int, str], waiting: dict[int, int], event_id: int, at: int, kind: str, request: int, ttl: int, most: int) -> tuple[tuple[int, str], list[tuple]]:
    """The state after an event, with the rows that it gives; `waiting` (request: asked at) is changed."""
    turns, digest = state
    rows = [(None, r, "expired", turns, digest) for r in sorted(r for r, t in waiting.items() if t + ttl < at)]
    for _, r, *_ in rows:
        del waiting[r]
    if kind == "ask":
        outcome = "repeated" if request in waiting else "asked"
        waiting.setdefault(request, at)
    elif turns >= most:
        outcome = "refused"
    elif request in waiting:
        del waiting[request]
        turns, digest, outcome = turns + 1, hashlib.md5(f"{digest}{event_id}".encode()).hexdigest(), "resolved"
    else:
        outcome = "stale"
    return (turns, digest), [*rows, (event_id, request, outcome, turns, digest)]


def _frame(key: int, rows: list[tuple]) -> pd.DataFrame:
    x = pd.DataFrame(rows, columns=["event_id", "request", "outcome", "turn", "digest"])
    x.insert(0, "key", key)
    return x.astype({"event_id": "Int64", "request": "int32", "turn": "int32"})


class Continuation(StatefulProcessor):
    def __init__(self, ttl: int, most: int):
        self.ttl, self.most = ttl, most

    def init(self, handle) -> None:
        self.handle = handle
        self.turns = handle.getValueState("turns", "turns int, digest string")
        self.waiting = handle.getMapState("waiting", "request int", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows))
        events = events.assign(at=millis(events["at"])).sort_values(["at", "event_id"])
        state = tuple(self.turns.get()) if self.turns.exists() else (0, "")
        before = {k[0]: v[0] for k, v in self.waiting.iterator()}
        waiting, out = dict(before), []
        for e in events.itertuples():
            state, got = step(state, waiting, int(e.event_id), int(e.at), e.kind, int(e.request), self.ttl, self.most)
            out += got
        self.turns.update(state)
        for r in before:
            if r not in waiting:
                self.waiting.removeKey((r,))
        for r, at in waiting.items():
            if before.get(r) != at:
                self.waiting.updateValue((r,), (at,))
                self.handle.registerTimer(at + self.ttl + 1)
        yield _frame(key[0], out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        gone = sorted(k[0] for k, v in self.waiting.iterator() if v[0] + self.ttl < now)
        for r in gone:
            self.waiting.removeKey((r,))
        turns, digest = tuple(self.turns.get()) if self.turns.exists() else (0, "")
        if gone:
            yield _frame(key[0], [(None, r, "expired", turns, digest) for r in gone])

    def close(self) -> None:
        pass


def streamed(events: DataFrame, ttl: int, most: int) -> DataFrame:
    """OUT of a stream with a watermark on `at`; the session's state store has to be PROVIDER."""
    return events.groupBy("key").transformWithStateInPandas(Continuation(ttl, most), OUT, "Append", "EventTime")


def in_batch(events: DataFrame, ttl: int, most: int, until: int) -> DataFrame:
    """OUT of a table of all events, with the clock at `until` (milliseconds) in the end; a key's events are a dialogue's, which a task holds."""

    def fold(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(at=millis(rows["at"])).sort_values(["at", "event_id"])
        state, waiting, out = (0, ""), {}, []
        for e in rows.itertuples():
            state, got = step(state, waiting, int(e.event_id), int(e.at), e.kind, int(e.request), ttl, most)
            out += got
        out += [(None, r, "expired", *state) for r, t in sorted(waiting.items()) if t + ttl < until]
        return _frame(key[0], out)

    return events.groupBy("key").applyInPandas(fold, OUT)
