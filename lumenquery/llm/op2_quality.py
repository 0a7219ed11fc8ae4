"""Quality rules: base counts, and a hashed word and character n-gram logistic regression.

The model learns from labelled rows (labels.quality): TRAIN_ROWS of each class
at most, those with the smallest MD5 of doc_id, a documented bound, as only a
classifier is fitted on them; labels given twice for a document count once, by
the smaller quality.  Features are the signed-free hashes of single words, word
pairs and 3- and 4-byte character n-grams in 2**BITS buckets, each text scaled
to length 1.  A third of the rows is held out of the fit and calibrates the score (Platt's
scaling).  Texts are scored in Arrow batches; a document is kept when the base
rules hold and its calibrated probability of bad quality is below THRESHOLD.

Defined results: null or blank text has no words, so base_failed is true;
without labels of both classes there is no model, and the base rules decide
alone.  Repeated rows give repeated results; other columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SEPARATORS, fresh, release, window_hashes, word_hashes

TRAIN_ROWS, BITS, THRESHOLD = 1500, 16, 0.5
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
#: Features that the fit opens at a time.
BLOCK = 1 << 16

MULT = np.uint32(0x85EBCA6B)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SEPARATORS)] = True
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(b"#*$%&|<>")] = True
_STARTS = (np.arange(256) & 0xC0) != 0x80  # bytes that start a code point


def buckets(text: str, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of a text, and how many grams each holds."""
    mask = np.uint64((1 << BITS) - 1)
    found = [window_hashes(words, 1) & mask]
    if len(words) > 1:
        found.append(window_hashes(words, 2) & mask)
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32)  # code points
    if len(c) > 3:
        three = (c[:-2] * MULT + c[1:-1]) * MULT + c[2:]
        for grams in (three, three[:-1] * MULT + c[3:]):
            h = (grams ^ (grams >> np.uint32(15))) * np.uint32(0x9E3779B1)
            found.append((h >> np.uint32(32 - BITS)).astype(np.uint64))
    counts = np.bincount(np.concatenate(found).astype(np.int64), minlength=1 << BITS)
    at = np.flatnonzero(counts)
    return at, counts[at]


def features(text: str, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers and values of a text; values have the length 1."""
    at, n = buckets(text, words)
    v = np.log1p(n)
    return at, v / max(np.sqrt(v @ v), 1e-12)


def counts(text: str | None, words: np.ndarray) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    if not text:
        return 0, 0, 0, 0, 0
    raw = np.bincount(np.frombuffer(text.encode("utf-8"), np.uint8), minlength=256)
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    n = len(words)
    repeated = 0
    if n > WINDOW:
        h = window_hashes(words, WINDOW)
        _, inverse, times = np.unique(h, return_inverse=True, return_counts=True)
        starts = np.flatnonzero(times[inverse] > 1)
        if len(starts):
            edge = np.zeros(n + 1, np.int64)
            np.add.at(edge, starts, 1)
            np.add.at(edge, starts + WINDOW, -1)
            repeated = int((np.cumsum(edge)[:n] > 0).sum())
    return n, int(raw[~_IS_SPACE & _STARTS].sum()), int(raw[_IS_SYMBOL].sum()), len(lines) - len(set(lines)), repeated


class Rows:
    """Features of consecutive texts in 6 bytes each: bucket, count; values are made again whenever they are used."""

    def __init__(self, found: list[tuple[np.ndarray, np.ndarray]]):
        self.size = len(found)
        self.at = np.concatenate([at for at, _ in found]).astype(np.min_scalar_type((1 << BITS) - 1))
        self.n = np.concatenate([n for _, n in found]).astype(np.uint32)
        self.row = np.array([len(at) for at, _ in found])
        self.some = np.flatnonzero(self.row)
        self.starts = (np.cumsum(self.row) - self.row)[self.some]
        self.length = np.array([max(np.sqrt(v @ v), 1e-12) for v in (np.log1p(n) for _, n in found)])

    def opened(self, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Buckets, and values before they are divided by their row's length."""
        return self.at.astype(np.intp), np.take(logs, self.n)

    def sums(self, x: np.ndarray) -> np.ndarray:
        """Of each row; rows without features have 0."""
        out = np.zeros(self.size)
        if len(self.some):
            out[self.some] = np.add.reduceat(x, self.starts)
        return out


def blocks(texts: Iterable[str]) -> Iterator[Rows]:
    """The texts' features, some BLOCK of them together."""
    found, size = [], 0
    for text in texts:
        found.append(buckets(text, word_hashes(text, lower=False)))
        size += len(found[-1][0])
        if size >= BLOCK:
            yield Rows(found)
            found, size = [], 0
    if found:
        yield Rows(found)


def fit(texts: Iterable[str], bad: np.ndarray, steps: int = 150) -> tuple[np.ndarray, float, float]:
    """Weights, and Platt's slope and intercept; rows in the given order, every third held out."""
    rows = list(blocks(texts))
    n = len(bad)
    ends = np.cumsum([0, *(x.size for x in rows)])
    logs = np.log1p(np.arange(max((int(x.n.max(initial=0)) for x in rows), default=0) + 1))
    held = np.arange(n) % 3 == 2
    y = bad.astype(float)
    use = np.where(held, 0.0, np.where(y > 0, 0.5 / max(y[~held].sum(), 1), 0.5 / max((1 - y)[~held].sum(), 1)))
    w, bias, m, s = np.zeros(1 << BITS), 0.0, 0.0, 0.0
    z, g = np.zeros(n), np.zeros(n)
    for t in range(1, steps + 2):  # Adam, whole batch, class-balanced; the last round only scores
        grad = 1e-6 * w
        for x, a, b in zip(rows, ends[:-1], ends[1:], strict=True):
            at, v = x.opened(logs)
            z[a:b] = x.sums(v * np.take(w, at)) / x.length + bias
            if t <= steps:
                g[a:b] = (1 / (1 + np.exp(-z[a:b])) - y[a:b]) * use[a:b]
                grad += np.bincount(at, v * np.repeat(g[a:b] / x.length, x.row), 1 << BITS)
        if t <= steps:
            grad = np.append(grad, g.sum())
            m, s = 0.9 * m + 0.1 * grad, 0.999 * s + 0.001 * grad**2
            step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-9)
            w, bias = w - step[:-1], bias - step[-1]
    return w, *_platt(z[held], y[held], bias)


def _platt(z: np.ndarray, y: np.ndarray, bias: float) -> tuple[float, float]:
    """Slope and intercept (with the model's bias in it) by Newton's method on smoothed targets."""
    if not 0 < y.sum() < len(y):
        return 1.0, bias
    goal = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    x, start = np.stack([z, np.ones_like(z)], 1), np.array([1.0, 0.0])

    def loss(p: np.ndarray) -> float:
        t = x @ p
        return float((np.logaddexp(0, t) - goal * t).sum() + 5e-4 * ((p - start) ** 2).sum())

    p = start
    for _ in range(100):
        q = 1 / (1 + np.exp(-np.clip(x @ p, -30, 30)))
        step = np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (q - goal) + 1e-3 * (p - start))
        while loss(p - step) > loss(p) and np.abs(step).max() > 1e-9:  # a whole step can lead away from the least loss
            step = step / 2
        p = p - step
        if np.abs(step).max() < 1e-8:
            break
    return float(p[0]), float(p[1] + p[0] * bias)


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float, float] | None:
    """The model, from a bounded sample of labelled rows; None without both classes."""
    one = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    pick = one.withColumn("h", F.md5(F.col("doc_id").cast("string").cast("binary")))
    ids = pick.where("quality = 0").orderBy("h", "doc_id").limit(TRAIN_ROWS).union(pick.where("quality <> 0").orderBy("h", "doc_id").limit(TRAIN_ROWS))
    some = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(ids), "doc_id")
    got = some.groupBy("doc_id", "h", "quality").agg(F.min("text").alias("text")).orderBy("h", "doc_id").select("quality", "text").toArrow()
    bad = got.column("quality").to_numpy() == 0
    release(docs.sparkSession)  # what planning has left on the heap would lie beside the fit
    return fit((x.as_py() for x in got.column("text")), bad) if 0 < bad.sum() < len(bad) else None


SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, bad_probability double"


def judge(docs: DataFrame, model: tuple[np.ndarray, float, float] | None, name: str = "__quality") -> DataFrame:
    """docs with a struct column `name` of SCHEMA; the other columns pass through.  A name that docs has is refused."""
    if fresh(docs, name) != name:
        raise ValueError(f"the documents have a column {name}")
    shared = docs.sparkSession.sparkContext.broadcast(None if model is None else (model[0].astype(np.float32), *model[1:]))  # 2**BITS floats

    @F.pandas_udf(SCHEMA)
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        fitted = shared.value
        for texts in batches:
            out = []
            for text in texts:
                words = word_hashes(text, lower=False)
                c = counts(text, words)
                failed = c[0] < MIN_WORDS or 100 * c[4] > MAX_REPEAT_PERCENT * c[0]
                p = 0.0
                if fitted is not None and text:
                    at, v = features(text, words)
                    p = float(1 / (1 + np.exp(-np.clip(fitted[1] * float(v @ fitted[0][at]) + fitted[2], -50, 50))))
                out.append((*c, failed, not failed and p < THRESHOLD, p))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.withColumn(name, score(F.col("text")))


def rate(docs: DataFrame, labels: DataFrame, name: str = "__quality") -> DataFrame:
    return judge(docs, train(docs, labels), name)


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that neither the base rules nor the model reject."""
    name = fresh(docs, "quality")
    return rate(docs, labels, name).where(F.col(name)["kept"]).drop(name)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return rate(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select("doc_id", "__quality.*")
