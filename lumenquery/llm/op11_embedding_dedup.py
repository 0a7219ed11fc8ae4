"""Embedding near-dedup: spherical k-means cells, blocked cosine products within cells, one representative a group.

1. Rows of equal vectors become one class with the number of its rows, before anything is compared.
2. Spherical k-means is fitted on at most SAMPLE classes (a stated bound; chosen by hash) into a cell for every CELL of
   them, at most CELLS: what is collected and broadcast has a size that doesn't grow.
3. Every class is at home in the cell of its nearest centroid, and visits other cells that are nearly as near: a class
   y within the link's distance of x can be at home in cell c only if x . (best - c) <= reach * |best - c|, reach the
   chord of the link's angle.  SLACK is the share of that bound that is kept: 1 finds every link for certain, but in
   many dimensions visits nearly all cells; a pair that is told apart by one of its two rows is still met by the other.
4. Homes and visitors of a cell are dealt into blocks of BLOCK rows by hash; each pair of blocks is a group of its own,
   so a cell with a third of all rows is many bounded tasks.  A pair of blocks gives a count a class and the edges of a
   spanning forest, never rows of links.  A pair of classes that meets in both its homes counts in the cell of the
   smaller number.
5. Components come from the forests' edges; the row of the least vec_id of each stays.

Cosines are of doubles, each vector divided by its length first.  Defined results: vectors that are null, empty or
zero or hold null or non-finite components link with nothing, nor do rows without a vec_id: their component is their
own vec_id and they are kept; shorter vectors count as padded with zeros; rows that share a vec_id are vectors of
their own; an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, materialize, small_batches

COSINE = 0.9
#: Rows that k-means is fitted on, rows a cell, cells, and numbers in all centroids: bounds of what the driver holds.
SAMPLE, CELL, CELLS, NUMBERS = 65_536, 256, 8192, 1 << 22
ROUNDS, SLACK, BLOCK = 8, 0.25, 1024


def unit(lists: pa.Array | pa.ChunkedArray, d: int) -> np.ndarray:
    """Rows of length one, padded with zeros to d numbers."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    x = np.zeros((len(lists), d))
    row = np.repeat(np.arange(len(lists)), sizes)
    x[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = lists.flatten().to_numpy(zero_copy_only=False)
    if d:
        x /= np.abs(x).max(1, keepdims=True)  # lengths that leave a double's range are no trouble then
        x /= np.sqrt((x * x).sum(1, keepdims=True))
    return x


def fit(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of length one, at most k."""
    centroids = x[np.random.default_rng(0).choice(len(x), k, replace=False)]
    for _ in range(rounds):
        home = np.concatenate([(x[i : i + 4096] @ centroids.T).argmax(1) for i in range(0, len(x), 4096)])
        order = np.argsort(home, kind="stable")
        cells, first = np.unique(home[order], return_index=True)
        sums = np.add.reduceat(x[order], first, axis=0)
        norm = np.sqrt((sums * sums).sum(1, keepdims=True))
        centroids = np.where(norm > 1e-12, sums / np.maximum(norm, 1e-12), centroids[cells])  # cells without rows go
    return centroids


def assign(x: np.ndarray, centroids: np.ndarray, cosine: float, slack: float) -> tuple[np.ndarray, list[np.ndarray]]:
    """Each row's home cell, and the other cells that it visits."""
    near = x @ centroids.T
    home = near.argmax(1)
    best = near[np.arange(len(x)), home]
    reach = slack * math.sqrt(2 - 2 * cosine)
    apart = np.sqrt(np.maximum(0, 2 - 2 * (centroids[home] @ centroids.T)))
    visit = near >= best[:, None] - reach * apart
    visit[np.arange(len(x)), home] = False
    row, cell = np.nonzero(visit)
    return home, np.split(cell, np.searchsorted(row, np.arange(1, len(x))))


def forest(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (row, least row of its component) of the links i - j among n rows."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            break
    at = np.flatnonzero(label != np.arange(n))
    return at, label[at]


LINKS = "node long, n_links long, other long"


def _met(rows: pa.Table, cosine: float, d: int, cells: int) -> pa.Table:
    """Links of one pair of blocks: rows with a count, and rows with an edge."""
    node, c, home, left, right = (rows.column(x).to_numpy() for x in ("node", "c", "home", "left", "right"))
    here, kind = rows.column("cell")[0].as_py(), rows.column("kind")[0].as_py()
    x = unit(rows.column("e"), d)
    a, b = np.flatnonzero(left), np.flatnonzero(right)
    i, j = (z.astype(np.int64) for z in np.nonzero(x[a] @ x[b].T >= cosine))
    i, j = a[i], b[j]
    some = i < j if kind == 0 else i != j  # a block with itself
    i, j = i[some], j[some]
    if kind == 2:  # visitors with homes: if the one at home visits the visitor's home, they meet there too
        visits = rows.column("visits").combine_chunks()
        at = np.repeat(np.arange(len(node)), visits.value_lengths().to_numpy(zero_copy_only=False))
        also = np.isin(j * cells + home[i], at * cells + visits.flatten().to_numpy(zero_copy_only=False))
        some = ~also | (here < home[i])
        i, j = i[some], j[some]
    count = np.bincount(i, c[j], len(node)) + np.bincount(j, c[i], len(node))
    some, (of, to) = np.flatnonzero(count), forest(i, j, len(node))
    return pa.table(
        [
            pa.array(np.concatenate([node[some], node[of]])),
            pa.array(np.concatenate([count[some].astype(np.int64), np.zeros(len(of), np.int64)])),
            pa.array(np.concatenate([node[some], node[to]])),
        ],
        ["node", "n_links", "other"],
    )


def links(classes: DataFrame, cosine: float = COSINE, slack: float = SLACK, cell: int = CELL, block: int = BLOCK, sample: int = SAMPLE) -> DataFrame:
    """LINKS of classes (node, c, e): counts of linked rows, and edges to another node of the component."""
    spark = classes.sparkSession
    n, d = classes.agg(F.count("*"), F.coalesce(F.max(F.size("e")), F.lit(0))).first()
    k = max(1, min(CELLS, NUMBERS // max(d, 1), n // cell))
    share = 1.0 if n <= sample else sample / n
    some = classes.where(F.pmod(F.xxhash64("e"), F.lit(1 << 30)) < int(share * (1 << 30))).select("e").toArrow() if k > 1 else None
    centroids = fit(unit(some.column("e"), d), min(k, some.num_rows)) if some is not None and some.num_rows else np.zeros((1, d))
    shared = spark.sparkContext.broadcast(centroids)  # at most NUMBERS doubles

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 1024) for b in batches for i in range(0, b.num_rows, 1024)):
            home, visits = assign(unit(batch.column("e"), d), shared.value, cosine, slack)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home.astype(np.int32)), pa.array([v.astype(np.int32) for v in visits], pa.list_(pa.int32()))], [*batch.schema.names, "home", "visits"])

    kind = classes.schema["e"].dataType.simpleString()
    settled = materialize(classes.mapInArrow(settle, f"node long, c long, e {kind}, home int, visits array<int>"), "settled")
    cells = len(centroids)
    at_home = settled.withColumn("cell", F.col("home"))
    visiting = settled.withColumn("cell", F.explode("visits"))
    blocks = lambda df, name: df.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias(name))
    # a row a cell, at most CELLS
    sizes = materialize(blocks(at_home.select("cell"), "homes").join(blocks(visiting.select("cell"), "visitors"), "cell", "left").fillna(0, ["visitors"]), "sizes")
    own = F.expr("cast(pmod(xxhash64(node), homes) as int)")
    every = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    pair = lambda kind, i, j, left, right: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), F.lit(left).alias("left"), F.lit(right).alias("right"))
    h = at_home.join(F.broadcast(sizes), "cell").withColumn("own", own)
    same = F.array(pair(0, F.col("own"), F.col("own"), True, True))
    above = F.transform(F.filter(every("homes"), lambda x: x > F.col("own")), lambda x: pair(1, F.col("own"), x, True, False))
    below = F.transform(F.filter(every("homes"), lambda x: x < F.col("own")), lambda x: pair(1, x, F.col("own"), False, True))
    met = F.when(F.col("visitors") > 0, F.transform(every("visitors"), lambda x: pair(2, x, F.col("own"), False, True))).otherwise(F.array().cast("array<struct<kind:int,i:int,j:int,left:boolean,right:boolean>>"))
    columns = ["cell", "node", "c", "e", "home", "visits"]
    h = h.select(*columns, F.explode(F.concat(same, above, below, met)).alias("p"))
    v = visiting.join(F.broadcast(sizes), "cell").withColumn("own", F.expr("cast(pmod(xxhash64(node), visitors) as int)"))
    v = v.select(*columns, F.explode(F.transform(every("homes"), lambda x: pair(2, F.col("own"), x, True, False))).alias("p"))
    rows = h.union(v).select(*columns, "p.*")
    with small_batches(spark):
        return materialize(rows.groupBy("cell", "kind", "i", "j").applyInArrow(lambda t: _met(t, cosine, d, cells), LINKS), "links")


def dedup(table: DataFrame, cosine: float = COSINE, slack: float = SLACK, cell: int = CELL, block: int = BLOCK, sample: int = SAMPLE) -> DataFrame:
    """vec_id, n_links, component_id, kept."""
    e = F.col("embedding")
    number = lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")), F.lit(False))
    usable = F.col("vec_id").isNotNull() & F.coalesce(F.forall(e, number) & F.exists(e, lambda x: x != 0), F.lit(False))
    v = materialize(table.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("e"), usable.alias("usable")), "vectors")
    classes = v.where("usable").groupBy("e").agg(F.count("*").alias("c"), F.min("vec_id").alias("least"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    found = links(classes.select("node", "c", "e"), cosine, slack, cell, block, sample)
    comp = components(found.where("node <> other").select("node", "other"), "node", "other")
    counts = found.groupBy("node").agg(F.sum("n_links").alias("n"))
    of = classes.join(comp, "node", "left").join(counts, "node", "left")
    of = materialize(of.select("e", "least", F.coalesce("comp", "node").alias("comp"), (F.coalesce("n", F.lit(0)) + F.col("c") - 1).alias("n_links")), "counted")
    of = of.join(of.groupBy("comp").agg(F.min("least").alias("component_id")), "comp").select("e", "n_links", "component_id")
    out = v.where("usable").join(of, "e").select("vec_id", "n_links", "component_id")
    alone = v.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def query(spark, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: All pairs; for tables without vectors that link with nothing.
ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
o AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
r(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, o.b FROM r JOIN o ON r.b = o.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY 1), n AS (SELECT a, count(*) AS n_links FROM o GROUP BY 1)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
"""
