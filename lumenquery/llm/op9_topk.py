"""Exact top-k search by inner product: an impact-ordered index, processed score at a time.

Vectors are turned into integers floor(256 * x) and dealt into blocks of BLOCK
rows, queries into blocks of QUERIES; a block of queries meets every block of
vectors in a group of its own, so no group grows with the table.  In a block
each dimension's values are quantised to LEVELS impacts; the rows of one
dimension and level are a posting segment.  For a query, the impact of a
segment is the most that it adds over the least that its dimension can add.
Segments are processed in rounds of descending impact: a row's accumulator
holds the impacts of the segments that it was seen in.  At a threshold T no
dimension in which a row was not seen can add T, which bounds every row's score
from above; quantisation bounds it from below.  After each round the rows with the best lower bounds are scored exactly.  Rows whose
upper bound is below the k-th best of these scores (or of an earlier block's) are out by proof; rounds go on until the rows left have
fewer components than there are postings left, or all segments are done.  A round that proves nothing is followed by the last, as the
bounds of evenly spread impacts only close there.  Possible members are rescored exactly.

Bounds are doubles with a margin for what their sums can lose, so components of any finite size keep the proof; scores are
rescored in 64 bits where all of a block's products fit, else in Python's integers.

Queries are the rows whose vec_id is divisible by STEP; candidates are all rows of another vec_id.  Ties go to
the smaller vec_id.  Defined results: vectors that are null or hold null or
non-finite components take no part, neither as query nor as candidate; null vec_ids neither; shorter vectors count as padded with zeros; rows
repeated with one vec_id and vector count once; a score among the best that a long can't hold, or a component of 2**1000 or more, is an error; an empty table gives
no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

K, STEP, BLOCK, QUERIES, LEVELS = 5, 50, 4096, 2048, 32
#: The widest number that Spark ranks; what is cut to it can't be among the best without an error.
WIDEST = 10**38 - 1
#: Shares of the largest impact down to which the rounds go, and how many leading rows are scored after each.
ROUNDS, LEAD = (0.5, 0.24, 0.0), 32


class Index:
    """Posting segments of a block of integer vectors, given as doubles of integers."""

    def __init__(self, x: np.ndarray):
        self.x = x
        m, d = x.shape
        low, high = x.min(0), x.max(0)
        with np.errstate(all="ignore"):  # widths beyond a double's range: one level
            level = np.nan_to_num(np.floor((x - low) / np.maximum(high - low, 1) * LEVELS), nan=0.0, posinf=0.0).clip(0, LEVELS - 1).astype(np.int64)
        self.rows = np.argsort(level, axis=0, kind="stable").T.copy()  # a dimension's rows by level
        self.cuts = np.stack([np.searchsorted(np.sort(level[:, j]), np.arange(LEVELS + 1)) for j in range(d)]) if d else np.zeros((0, LEVELS + 1), np.int64)
        self.size = np.diff(self.cuts, axis=1)
        self.full = self.size > 0
        self.low, self.high = np.zeros((d, LEVELS)), np.zeros((d, LEVELS))
        for j in range(d):
            at, values = self.cuts[j, :-1][self.full[j]], x[self.rows[j], j]
            self.low[j, self.full[j]], self.high[j, self.full[j]] = np.minimum.reduceat(values, at), np.maximum.reduceat(values, at)
        self.most = np.abs(x).max(initial=0)

    def members(self, q: np.ndarray, k: int, floor: float, own: np.ndarray) -> np.ndarray:
        """Rows that may be among the k best for q; none of the others can (nor reach floor)."""
        m, d = self.x.shape
        if not d:
            return np.flatnonzero(~own)
        with np.errstate(all="ignore"):
            a, b = q[:, None] * self.low, q[:, None] * self.high
            most, least = np.maximum(a, b), np.minimum(a, b)
            scale = np.maximum(np.abs(most), np.abs(least)).max(1).sum()
        if not scale < 1e300:  # products beyond a double's range: nothing is proved
            return np.flatnonzero(~own)
        margin = scale * (4 * d + 16) * 2.0**-52
        floor = float(min(max(floor, -1e301), 1e301)) - margin
        base = np.where(self.full, least, np.inf).min(1)
        impact = np.where(self.full, most - base[:, None], -1.0)
        slack = np.where(self.full, most - least, 0.0).max(1).sum()
        top, done = impact.max(initial=0), np.zeros_like(self.full)
        sum_of_bases = base.sum()
        # where sums stay below 2**53, one addition counts a segment too, in the low bits
        pack = float(1 << (d + 1).bit_length())
        packed = 2 * scale * pack < 2.0**53
        total, seen = np.zeros(m), np.zeros(m, np.int64)
        possible = ~own
        for share in ROUNDS:
            if 0 < share < ROUNDS[0] and np.array_equal(possible, ~own):
                continue
            limit = top * share
            now = self.full & ~done & (impact >= limit)
            done |= now
            dims, levels = np.nonzero(now)
            if len(dims):
                # segments that lie one behind the other are read as one
                starts, ends, sizes = dims * m + self.cuts[dims, levels], dims * m + self.cuts[dims, levels + 1], self.size[dims, levels]
                parts = np.flatnonzero(np.append(True, starts[1:] != ends[:-1]))
                rows = np.concatenate([self.rows.ravel()[s:e] for s, e in zip(starts[parts].tolist(), ends[np.append(parts[1:] - 1, -1)].tolist(), strict=True)])
                if packed:
                    total += np.bincount(rows, np.repeat(impact[dims, levels] * pack + 1, sizes), m)
                else:
                    total += np.bincount(rows, np.repeat(impact[dims, levels], sizes), m)
                    seen += np.bincount(rows, minlength=m)
            got = np.floor(total / pack) if packed else total
            seen = total - got * pack if packed else seen
            upper = got + (d - seen) * limit + sum_of_bases + margin
            lower = got - slack + sum_of_bases - margin
            lower[own] = -np.inf
            few = max(LEAD, 2 * k)
            lead = np.argpartition(lower, m - few)[m - few :] if m > few else np.arange(m)
            best = sorted(self.scores(lead[~own[lead]], q))[-k:]
            theta = max(floor, best[0] - margin) if len(best) == k else floor
            possible = (upper >= theta) & ~own
            if possible.sum() * d <= self.size[~done].sum():
                break
        return np.flatnonzero(possible)

    def scores(self, rows: np.ndarray, q: np.ndarray) -> list[int]:
        """Exact inner products."""
        if float(self.most) * float(np.abs(q).max(initial=0)) * max(len(q), 1) < 2.0**62:
            return (self.x[rows].astype(np.int64) @ q.astype(np.int64)).tolist()
        other = [int(v) for v in q]
        return [sum(int(a) * b for a, b in zip(self.x[i], other, strict=True)) for i in rows]


def top_of_block(vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int = K, size: int = BLOCK) -> list[tuple[int, int, int]]:
    """(query_id, vec_id, score) of each query's k best of these vectors."""
    # blocks are dealt by hash, so they hold some more or less than `size`
    cuts = np.linspace(0, len(ids), max(1, round(len(ids) / size)) + 1).astype(np.int64).tolist()
    parts = [(Index(vectors[a:b]), ids[a:b]) for a, b in zip(cuts, cuts[1:])]
    out = []
    for q, own in zip(queries, query_ids, strict=True):
        best: list[tuple[int, int]] = []
        for index, at in parts:
            floor = -best[k - 1][0] if len(best) >= k else -np.inf
            rows = index.members(q, k, floor, at == own)
            best = sorted(best + [(-s, i) for s, i in zip(index.scores(rows, q), at[rows].tolist(), strict=True)])[:k]
        out += [(int(own), i, -s) for s, i in best]
    return out


def _matrix(lists, d: int) -> np.ndarray:
    """floor(256 * x) of each component, as doubles of integers."""
    out = np.zeros((len(lists), d))
    for i, v in enumerate(lists):
        out[i, : len(v)] = v
    return np.floor(256 * out)


def search(table: DataFrame, k: int = K, step: int = STEP) -> DataFrame:
    """query_id, rank, vec_id, score."""
    spark = table.sparkSession
    x = F.transform("embedding", lambda v: v.cast("double"))
    usable = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & F.forall("embedding", lambda v: F.coalesce(~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")), F.lit(False)))
    v = materialize(table.where(usable).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("v")).distinct(), "vectors")
    is_query = F.col("vec_id") % step == 0
    n, nq = v.agg(F.count("*"), F.count_if(is_query)).first()
    blocks, qblocks = max(1, -(-n // BLOCK)), max(1, -(-nq // QUERIES))
    block = lambda salt, of: F.pmod(F.xxhash64(F.lit(salt), F.col("vec_id")), F.lit(of))
    left = v.withColumn("vb", block("v", blocks)).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(qblocks - 1))))
    right = v.where(is_query).withColumn("qb", block("q", qblocks)).withColumn("vb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def work(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(vectors) and len(queries):
            d = max(vectors["v"].map(len).max(), queries["v"].map(len).max())
            if max(np.abs(np.concatenate(v)).max(initial=0) for v in (vectors["v"], queries["v"])) >= 2.0**1000:
                raise ValueError("components of 2**1000 or more")
            rows = top_of_block(_matrix(vectors["v"], d), vectors["vec_id"].to_numpy(), _matrix(queries["v"], d), queries["vec_id"].to_numpy(), k)
        return pd.DataFrame([(q, i, Decimal(max(-WIDEST, min(WIDEST, s)))) for q, i, s in rows], columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64"})

    ks = ["vb", "qb"]
    ints = lambda df: df.select(F.col("vb").cast("int"), F.col("qb").cast("int"), "vec_id", "v")
    local = ints(left).groupBy(*ks).cogroup(ints(right).groupBy(*ks)).applyInPandas(work, "query_id long, vec_id long, score decimal(38,0)")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    exact = F.when(F.abs("score") < F.lit(Decimal(1 << 63)), F.col("score").cast("long")).otherwise(F.raise_error(F.lit("a score is beyond a long")).cast("long"))
    return local.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", exact.alias("score"))


def query(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
