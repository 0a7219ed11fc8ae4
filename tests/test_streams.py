"""Keyed state and joined streams over several files, with restarts, against their batch twins."""

import tempfile
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lumenquery.streaming import continuation as C
from lumenquery.streaming import events as S
from lumenquery.streaming import reconcile as R

T0 = datetime(2024, 1, 1)
HOUR = 3_600_000


def at(h):
    return T0 + timedelta(hours=h)


DIALOGUE = [  # key, hour, kind, request
    (1, 0, "ask", 1), (1, 1, "ask", 1), (1, 2, "answer", 1), (1, 3, "answer", 1), (1, 4, "ask", 2), (1, 40, "answer", 2), (2, 5, "answer", 3), (2, 6, "ask", 3), (2, 7, "answer", 3),
    (3, 8, "ask", 5), (3, 9, "ask", 6), (3, 10, "answer", 6), (3, 11, "ask", 7), (3, 12, "answer", 7), (3, 13, "ask", 7), (3, 14, "answer", 7), (3, 15, "answer", 5), (4, 16, "ask", 9), (5, 60, "ask", 1),
]


def events(spark, rows):
    return spark.createDataFrame([(k, at(h), i, kind, r) for i, (k, h, kind, r) in enumerate(rows)], "key long, at timestamp, event_id long, kind string, request int")


@pytest.mark.parametrize("cuts", [[], [3], [2, 6, 11, 15]])
def test_continuation_survives_restarts(spark, cuts):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    ttl, most = 24 * HOUR, 2
    every = events(spark, DIALOGUE)
    until = int((at(60) - datetime(1970, 1, 1)).total_seconds() * 1000)
    want = Counter(map(tuple, C.in_batch(every, ttl, most, until).collect()))
    rows = sorted(every.collect(), key=lambda r: r.at)
    for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True):
        spark.createDataFrame(rows[a:b], every.schema).coalesce(1).write.mode("append").parquet(f"file://{folder}/in")
        stream = spark.readStream.schema(every.schema).parquet(f"file://{folder}/in").withWatermark("at", "0 seconds")
        with C.state_store(spark):  # each piece is an application of its own, which goes on from the checkpoint
            S.run_once(C.streamed(stream, ttl, most), f"file://{folder}/out", f"file://{folder}/checkpoint", "append")
    got = Counter(map(tuple, spark.read.schema(C.OUT).parquet(f"file://{folder}/out").drop("batch").collect()))
    assert got == want
    assert {r[3] for r in want} == {"asked", "repeated", "resolved", "stale", "refused", "expired"}


def test_continuation_step():
    state, waiting = (0, ""), {}
    for i, (t, kind, r, want) in enumerate([(0, "ask", 1, ["asked"]), (5, "answer", 1, ["resolved"]), (6, "answer", 1, ["stale"]), (7, "ask", 1, ["asked"]), (18, "answer", 1, ["expired", "stale"]), (19, "ask", 2, ["asked"]), (29, "answer", 2, ["resolved"]), (30, "answer", 2, ["refused"])]):
        state, rows = C.step(state, waiting, i, t, kind, r, 10, 2)
        assert [x[2] for x in rows] == want, i
    assert state[0] == 2 and waiting == {}


def test_reconciliation_in_pieces(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    schema = "key long, id long, at timestamp"
    left = [(1, 1, 0), (1, 2, 30), (2, 3, 1), (3, 4, 2), (4, 5, 90), (5, 6, 100)]
    right = [(1, 11, 3), (1, 12, 4), (1, 13, 50), (2, 14, 40), (9, 15, 5), (4, 16, 91), (7, 17, 100)]
    made = lambda rows: spark.createDataFrame([(k, i, at(h)) for k, i, h in rows], schema)
    want = {tuple(r) for r in R.outcomes(R.meet(made(left), made(right), "24 hours"), F.lit(at(100)), "24 hours", "6 hours").collect()}
    assert want == {(1, 1, "matched", 11), (1, 2, "late", 13), (2, 3, "missing", None), (3, 4, "missing", None)}
    for low, high in ((-1, 10), (10, 45), (45, 101)):
        for name, rows in (("left", left), ("right", right)):
            made([r for r in rows if low < r[2] <= high]).coalesce(1).write.mode("append").parquet(f"file://{folder}/{name}")
        stream = lambda name: spark.readStream.schema(schema).parquet(f"file://{folder}/{name}").withWatermark("at", "1 hour")
        S.run_once(R.meet(stream("left"), stream("right"), "24 hours"), f"file://{folder}/out", f"file://{folder}/checkpoint", "append")
    met = spark.read.schema("key long, announced_id long, announced_at timestamp, arrived_id long, arrived_at timestamp").parquet(f"file://{folder}/out")
    assert {tuple(r) for r in R.outcomes(met, F.lit(at(99)), "24 hours", "6 hours").collect()} == want
