"""Derived tables that are written once and read by later queries and applications, as long as their inputs stand."""

from __future__ import annotations

import gc
import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Of what builds derived tables; another number, and what earlier builds have left isn't read.
VERSION = 1


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; on a local master, where all run on one machine, a folder of our own if it is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(path)
    if "://" not in path and not path.startswith("file:"):
        path = f"file://{path}"
    return path.rstrip("/")


def hadoop(spark: SparkSession, path: str):
    """The file system of a path, and the path, as Spark's own readers see them."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def fingerprint(spark: SparkSession, *paths: str) -> str:
    """A digest of the names, sizes and times of all files below the paths; of their list, so nothing is read."""
    out = hashlib.sha256()
    for path in paths:
        fs, p = hadoop(spark, path)
        if not fs.exists(p):
            continue
        files, found = fs.listFiles(p, True), []
        while files.hasNext():
            f = files.next()
            found.append(f"{f.getPath()}\n{f.getLen()}\n{f.getModificationTime()}\n")
        out.update("".join(sorted(found)).encode() + b"\0")
    return out.hexdigest()


def once(spark: SparkSession, key: str, inputs: list[str], build: Callable[[], DataFrame], by: list[str] | None = None) -> DataFrame:
    """The table of this key and of the inputs (paths) as they stand now, written if no application has written it before.

    A changed input has another fingerprint, so what was derived from the old one isn't read again.  The table appears
    by a rename when it is whole; of two writers at a time the first one's stays.
    """
    name = hashlib.sha256(f"{VERSION}\n{key}\n{fingerprint(spark, *inputs)}".encode()).hexdigest()[:32]
    path = f"{shared_folder(spark)}/stored-{name}"
    fs, target = hadoop(spark, path)
    if not fs.exists(target):
        mine = f"{path}-{uuid.uuid4().hex}"
        writer = build().write
        (writer.partitionBy(*by) if by else writer).parquet(mine)
        _, source = hadoop(spark, mine)
        if fs.exists(target) or not fs.rename(source, target):
            fs.delete(source, True)
    return spark.read.parquet(path)


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows, written to the shared folder, compressed, and read again; shuffle files behind them go."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    release(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Shuffle files behind a stored table are of no use any more, but stay until the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
