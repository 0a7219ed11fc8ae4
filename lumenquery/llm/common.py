"""What several operators share: the shared folder, words, hashes, components."""

from __future__ import annotations

import gc
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but these bytes; bytes.split() splits UTF-8 at just these.
SEPARATORS = b" \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); on a local master, where all run on one machine, one of our own if it is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(path)
    if "://" not in path:
        path = path if path.startswith("file:") else f"file://{path}"
    return path.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def release(spark: SparkSession) -> None:
    """Shuffle files behind written tables are of no use any more, but stay until the driver collects its garbage, which it rarely has to; for between the larger steps of a job."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(*tables: DataFrame) -> None:
    """Delete what materialize() wrote, once all that read it are written themselves."""
    for df in tables:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df.written_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


@contextmanager
def settings(spark: SparkSession, **values: str | int):
    """Session settings (dots written as __) for one write; the session's own come back after it."""
    names = {k.replace("__", "."): str(v) for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def small_batches(spark: SparkSession, rows: int = 1000):
    """Arrow batches of few rows, for a write of whole texts."""
    return settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch=rows)


def word_hashes(text: str | None, lower: bool = True) -> np.ndarray:
    """64-bit hashes of the words of a text, A-Z lowered or as they stand."""
    from xxhash import xxh3_64_intdigest

    raw = text.encode("utf-8") if text else b""
    words = (raw.lower() if lower else raw).split()
    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k consecutive words; of the whole sequence if it is shorter."""
    k = min(k, len(h))
    if not k:
        return h[:0]
    n = len(h) - k + 1
    out = h[:n] + np.uint64(k)
    for i in range(1, k):
        out = out * np.uint64(0x9FB21C651E98DF25) + h[i : i + n]
    return mix(out)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected edges: (node, comp), comp the least node of the component.

    Every round each node takes the least label of its neighbours (aggregated
    before the shuffle), then the label of its label; rounds end when nothing
    changes.  Each round is checkpointed.  No edges: no rows.
    """
    both = edges.select(F.col(a).alias("x"), F.col(b).alias("y"))
    both = materialize(both.union(both.select("y", "x")).where("x <> y").distinct(), "edges")
    labels = both.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("m")).select("node", F.least("node", "m").alias("comp")).checkpoint()
    while True:
        near = both.join(labels.select(F.col("node").alias("y"), "comp"), "y").groupBy(F.col("x").alias("node")).agg(F.min("comp").alias("m"))
        low = labels.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "m").alias("low"))
        up = labels.select(F.col("node").alias("low"), F.col("comp").alias("up"))
        new = low.join(up, "low").select("node", "old", F.least("low", "up").alias("comp")).checkpoint()
        labels = new.select("node", "comp")
        if not new.where("old <> comp").take(1):
            return labels
