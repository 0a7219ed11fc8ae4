"""Event-time windows in batch, and as streams that take all files and stop (ST-10)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lumenquery.sources.stored import shared_folder
from lumenquery.sources.tables import table
from lumenquery.streaming import continuation as C
from lumenquery.streaming import events as S
from lumenquery.streaming import reconcile as R


def _folder(spark):
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def _events(spark, d):
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _naive(df):
    return df.withColumn("start", F.col("start").cast("timestamp_ntz"))


def tumbling_1d(spark, d):
    return _naive(S.tumbling(_events(spark, d)))


def sliding_1d_6h(spark, d):
    return _naive(S.sliding(_events(spark, d)))


def session_30m(spark, d):
    return _naive(S.sessions(_events(spark, d)))


def stream_tumbling(spark, d):
    """The stream's updates, the last of each window; equal to the batch twin's rows where nothing is late."""
    f = _folder(spark)
    S.run_once(S.tumbling(S.read_events(spark, f"{d}/events.parquet")), f"{f}/out", f"{f}/checkpoint")
    return _naive(S.upserted(spark, f"{f}/out", ["start", "event_type"]))


def stream_dedupe(spark, d):
    """Users and types: the stream drops what comes again within the watermark, the reader what comes again after it."""
    f = _folder(spark)
    e = S.read_events(spark, f"{d}/events.parquet").select("ts", "user_id", "event_type")
    S.run_once(S.first_of_key(e, "user_id", "event_type").select("user_id", "event_type"), f"{f}/out", f"{f}/checkpoint", "append")
    return spark.read.parquet(f"{f}/out").select("user_id", "event_type").distinct()


#: How long a request waits (milliseconds), and how many turns a dialogue has.
TTL, TURNS = 3 * 86_400_000, 8


def _dialogue(events):
    """Signups ask, clicks answer; the tens of `k` say what about."""
    kind = F.when(F.col("event_type") == "signup", "ask").when(F.col("event_type") == "click", "answer")
    request = F.floor(F.get_json_object("props", "$.k").cast("int") / 10).cast("int")
    return events.where("event_type in ('signup', 'click')").select(F.col("user_id").alias("key"), F.col("ts").alias("at"), "event_id", kind.alias("kind"), request.alias("request"))


def _outcomes(rows):
    count = [F.count_if(F.col("outcome") == o).alias(o) for o in ("asked", "repeated", "resolved", "stale", "refused", "expired")]
    return rows.groupBy("key").agg(*count, F.max_by("digest", "turn").alias("digest"))


def continuation_batch(spark, d):
    events = _dialogue(_events(spark, d))
    until = events.agg(F.unix_millis(F.max("at")).alias("m")).first()["m"] or 0
    return _outcomes(C.in_batch(events, TTL, TURNS, until))


def continuation_stream(spark, d):
    """QU-09/10: the same dialogues as a stream with keyed state and timers; the last watermark is the time of the last event that they have."""
    f = _folder(spark)
    events = _dialogue(S.read_events(spark, f"{d}/events.parquet", None)).withWatermark("at", "0 seconds")
    with C.state_store(spark):
        S.run_once(C.streamed(events, TTL, TURNS), f"{f}/out", f"{f}/checkpoint", "append")
    return _outcomes(spark.read.schema(C.OUT).parquet(f"{f}/out"))


#: After how long an announcement is over, and until when an arrival is in time.
WITHIN, ON_TIME = "2 days", "6 hours"


def _sides(events):
    side = lambda kind: events.where(F.col("event_type") == kind).select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.col("ts").alias("at"))
    return side("click"), side("purchase")


def _told(spark, d):
    """Until when both sides have told all: the lesser of their last times, which is also the two streams' last watermark."""
    return F.lit(min((side.agg(F.max("at")).first()[0] for side in _sides(_events(spark, d))), key=lambda t: (t is not None, t)))


def reconcile_batch(spark, d):
    return R.outcomes(R.meet(*_sides(_events(spark, d)), WITHIN), _told(spark, d), WITHIN, ON_TIME)


def reconcile_stream(spark, d):
    """JON-21, ST-06: clicks against purchases that follow them, both as streams; nulls come with the watermark."""
    f = _folder(spark)
    left, right = (_sides(S.read_events(spark, f"{d}/events.parquet", None))[i].withWatermark("at", "0 seconds") for i in (0, 1))
    S.run_once(R.meet(left, right, WITHIN), f"{f}/out", f"{f}/checkpoint", "append")
    met = spark.read.schema("key long, announced_id long, announced_at timestamp, arrived_id long, arrived_at timestamp").parquet(f"{f}/out")
    return R.outcomes(met, _told(spark, d), WITHIN, ON_TIME)


QUERIES = {f.__name__: f for f in (tumbling_1d, sliding_1d_6h, session_30m, stream_tumbling, stream_dedupe, continuation_batch, continuation_stream, reconcile_batch, reconcile_stream)}
_TUMBLE = "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"
#: One event of every dialogue a step; `w` holds when each of the ten requests was asked, null if it doesn't wait.
_CONTINUE = f"""WITH RECURSIVE ev AS (SELECT user_id AS key, epoch_ms(ts) AS tm, event_id, event_type = 'signup' AS ask, CAST(floor(CAST(json_extract_string(props, '$.k') AS INTEGER) / 10) AS INTEGER) AS r,
row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts), event_id) AS i FROM events WHERE event_type IN ('signup', 'click')),
st(key, i, w, turns, digest, asked, repeated, resolved, stale, refused, expired) AS (
SELECT DISTINCT key, CAST(0 AS BIGINT), list_transform(range(10), lambda j: CAST(NULL AS BIGINT)), 0, '', 0, 0, 0, 0, 0, 0 FROM ev
UNION ALL SELECT key, i, list_transform(range(10), lambda j: CASE WHEN j <> r THEN w[j + 1] WHEN o = 'asked' THEN tm WHEN o = 'resolved' THEN NULL ELSE w[j + 1] END),
turns + CAST(o = 'resolved' AS INTEGER), CASE WHEN o = 'resolved' THEN md5(digest || event_id) ELSE digest END, asked + CAST(o = 'asked' AS INTEGER), repeated + CAST(o = 'repeated' AS INTEGER), resolved + CAST(o = 'resolved' AS INTEGER),
stale + CAST(o = 'stale' AS INTEGER), refused + CAST(o = 'refused' AS INTEGER), expired + gone
FROM (SELECT *, CASE WHEN ask AND w[r + 1] IS NULL THEN 'asked' WHEN ask THEN 'repeated' WHEN turns >= {TURNS} THEN 'refused' WHEN w[r + 1] IS NOT NULL THEN 'resolved' ELSE 'stale' END AS o
FROM (SELECT st.* EXCLUDE (i, w), ev.i, ev.tm, ev.event_id, ev.ask, ev.r, list_transform(st.w, lambda x: CASE WHEN x + {TTL} < ev.tm THEN NULL ELSE x END) AS w, CAST(len(list_filter(st.w, lambda x: x + {TTL} < ev.tm)) AS INTEGER) AS gone
FROM st JOIN ev ON ev.key = st.key AND ev.i = st.i + 1)))
SELECT key, CAST(asked AS BIGINT) AS asked, CAST(repeated AS BIGINT) AS repeated, CAST(resolved AS BIGINT) AS resolved, CAST(stale AS BIGINT) AS stale, CAST(refused AS BIGINT) AS refused,
CAST(expired + len(list_filter(w, lambda x: x + {TTL} < until)) AS BIGINT) AS expired, digest FROM st, (SELECT max(tm) AS until FROM ev) QUALIFY row_number() OVER (PARTITION BY key ORDER BY i DESC) = 1"""

_RECONCILE = """WITH u AS (SELECT least(max(ts) FILTER (WHERE event_type = 'click'), max(ts) FILTER (WHERE event_type = 'purchase')) AS until FROM events), a AS (SELECT user_id AS key, event_id, ts FROM events, u WHERE event_type = 'click' AND ts + INTERVAL 2 DAY < until),
b AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'purchase'),
m AS (SELECT key, a.event_id AS announced_id, a.ts AS t, b.event_id AS arrived_id, b.ts AS s FROM a LEFT JOIN b ON b.user_id = key AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 2 DAY QUALIFY row_number() OVER (PARTITION BY key, announced_id ORDER BY s, arrived_id) = 1)
SELECT key, announced_id, CASE WHEN arrived_id IS NULL THEN 'missing' WHEN s <= t + INTERVAL 6 HOUR THEN 'matched' ELSE 'late' END AS outcome, arrived_id FROM m"""

ORACLES = {
    "reconcile_batch": _RECONCILE,
    "reconcile_stream": _RECONCILE,
    "continuation_batch": _CONTINUE,
    "continuation_stream": _CONTINUE,
    "tumbling_1d": _TUMBLE,
    "stream_tumbling": _TUMBLE,
    "sliding_1d_6h": "SELECT time_bucket(INTERVAL 6 HOUR, ts) - i * INTERVAL 6 HOUR AS start, count(*) AS n FROM events, range(4) t(i) GROUP BY 1",
    "session_30m": "WITH x AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS f FROM events), y AS (SELECT user_id, ts, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM x) SELECT user_id, min(ts) AS start, count(*) AS n FROM y GROUP BY user_id, s",
    "stream_dedupe": "SELECT DISTINCT user_id, event_type FROM events",
}
