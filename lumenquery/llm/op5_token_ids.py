"""Token-ID output: list columns in Parquet with dictionary pages, controlled row groups and page indexes.

encode() deals documents by doc_id ranges, encodes each with a public tokenizer
and writes one file a range, its rows in ascending doc_id order (ties: by a hash of the
text; null ids first).  A row holds doc_id, the ids, their number, and part and row,
which order all rows.  Spark's Parquet writer makes dictionary pages for the ids (they come
from a bounded vocabulary), row groups of ROW_GROUP bytes and the column and
offset indexes of pages of PAGE_ROWS rows, so a reader that wants only metadata
or some documents skips the ids' pages.  locate() gives each document's place in the stream of all ids.

No token of this tokenizer reaches over white space, so words are encoded once
a worker and looked up from then on; the cache is emptied at CACHE words.  Texts
that hold a special token's string are encoded whole.

Defined results: null text is empty and has the end id only; an empty table gives no
rows; repeated rows are written as often as they come.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import new_folder, small_batches

#: SLICE: documents encoded at a time.
END, CACHE, SLICE, ROW_GROUP, PAGE_ROWS = 1, 700_000, 256, 32 << 20, 2000
END_BYTES = np.int32(END).tobytes()


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Encodes texts of a batch by their words, each word once.

    A-Z are lowered first, as the tokenizer does anyway.  Sentence marks behind a letter are tokens of their own, so a
    word with them is its core and they.  Words are encoded many at a time: a plain lower-case one is then one run of pieces, the last with
    the vocabulary's word end; the ids of others are told by the places of their characters.  The tokenizer's rules of normal forms and of
    what a word is change nothing in words of a-z alone, so its model gets these without them.
    """

    MARKS = b".,!?;:"

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.bare = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.bare.normalizer, self.bare.pre_tokenizer = None, pre_tokenizers.WhitespaceSplit()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[bytes, bytes] = {}  # a word and its ids
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True

    def learn(self, words: set[bytes]) -> None:
        letters = [w for w in words if w.isalpha()]  # of bytes: a-z, as A-Z are lowered
        other = self.learn_plain(letters, lambda t: self.bare.encode_batch_fast([t], add_special_tokens=False)[0].ids)
        rest = [(w, w.decode("utf-8")) for w in words.difference(letters)]
        plain = [w for w, text in rest if text.isalpha() and text.islower() and max(text) < "\u0250"]
        other += self.learn_plain(plain, lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids)
        plain = set(plain)
        self.learn_other([(w, w.decode("utf-8")) for w in other] + [x for x in rest if x[0] not in plain])

    def learn_plain(self, words: list[bytes], encode: Callable[[str], list[int]]) -> list[bytes]:
        """Returns the words that can't be told apart by their ends."""
        other = []
        for i in range(0, len(words), 500):
            some = words[i : i + 500]
            ids = np.array(encode(b" ".join(some).decode("utf-8")), np.int32)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(some):
                self.keep(some, ids, cuts)
            else:
                other += some
        return other

    def learn_other(self, other: list[tuple[bytes, str]]) -> None:
        for i in range(0, len(other), 500):
            some = other[i : i + 500]
            if any(s in " ".join(t for _, t in some) for s in self.special):
                apart = [x for x in some if any(s in x[1] for s in self.special)]
                self.known.update((w, np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.int32).tobytes()) for w, t in apart)
                some = [x for x in some if x not in apart]
            text = " ".join(t for _, t in some)
            # a token is of the word that its first character is in
            got = self.tokenizer.encode(text, add_special_tokens=False)
            first = np.fromiter((a for a, _ in got.offsets), np.int64, len(got))
            self.keep([w for w, _ in some], np.array(got.ids, np.int32), np.searchsorted(first, np.cumsum([len(t) + 1 for _, t in some])))

    def keep(self, words: list[bytes], ids: np.ndarray, ends: np.ndarray) -> None:
        raw, at = ids.tobytes(), (4 * np.append(0, ends)).tolist()
        self.known.update(zip(words, map(raw.__getitem__, map(slice, at, at[1:])), strict=True))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        raws = [t.encode("utf-8").lower() for t in texts]
        words = [r.split() for r in raws]
        if len(self.known) > CACHE:
            self.known.clear()
        # one look at each word; those that are new are filled in
        found = [list(map(self.known.get, ws)) for ws in words]
        gaps = [[i for i, x in enumerate(ids) if x is None] for ids in found]
        fresh = {ws[i] for ws, places in zip(words, gaps, strict=True) for i in places}
        cores = {w: core for w in fresh if (core := w.rstrip(self.MARKS)) != w and core[-1:].isalpha()}
        self.learn(((fresh - cores.keys()) | set(cores.values()) | {w[len(c) :] for w, c in cores.items()}).difference(self.known))
        self.known.update({w: self.known[c] + self.known[w[len(c) :]] for w, c in cores.items()})
        out = []
        for text, raw, ws, ids, places in zip(texts, raws, words, found, gaps, strict=True):
            if any(s.encode() in raw for s in self.special):
                ids = [np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32).tobytes()]
            else:
                for i in places:
                    ids[i] = self.known[ws[i]]
            ids.append(END_BYTES)
            out.append(np.frombuffer(b"".join(ids), np.int32))
        return out


def encoder(path: str) -> Encoder:
    """The worker's encoder: it outlives a task where Spark uses the worker again, so common words are encoded once a worker."""
    import tokenizers

    kept = tokenizers.__dict__.setdefault("_kept_encoders", {})  # this module travels by value, so its own globals end with the task
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


def encode(docs: DataFrame, path: str | None = None, folder: str | None = None) -> DataFrame:
    """Write the ids; the files read back: doc_id, part, row, n_tokens, ids."""
    spark = docs.sparkSession
    path, folder = path or tokenizer_path(), folder or new_folder(spark, "token-ids")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, part, row = encoder(path), TaskContext.get().partitionId(), 0
        for batch in (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
            ids = own.encode([t or "" for t in batch.column("text").to_pylist()])
            n = np.array([len(x) for x in ids], np.int64)
            offsets = pa.array(np.append(0, np.cumsum(n)).astype(np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.full(len(n), part, np.int32)), pa.array(np.arange(row, row + len(n))), pa.array(n), lists],
                ["doc_id", "part", "row", "n_tokens", "ids"],
            )
            row += len(n)

    schema = "doc_id long, part int, row long, n_tokens long, ids array<int>"
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select("doc_id", "text").withColumn("tie", F.xxhash64("text")).repartitionByRange(ranges, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    spark_conf = {
        "compression": "zstd", "parquet.block.size": str(ROW_GROUP), "parquet.page.row.count.limit": str(PAGE_ROWS),
        "parquet.enable.dictionary": "true", "parquet.enable.dictionary#doc_id": "false", "parquet.writer.version": "PARQUET_2_0",
    }
    with small_batches(spark):
        ordered.mapInArrow(work, schema).write.options(**spark_conf).parquet(folder)
    return spark.read.schema(schema).parquet(folder)


def locate(encoded: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    @F.pandas_udf("long")
    def crc(lists: pd.Series) -> pd.Series:
        return lists.map(lambda x: zlib.crc32(np.asarray(x).astype("<u4").tobytes()))

    # one row a file, so this window over all of them is as small as the list of files
    parts = encoded.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    local = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("row")) - F.col("n_tokens")
    rows = encoded.select("doc_id", "part", "row", "n_tokens", crc("ids").alias("ids_crc32")).withColumn("local", local)
    return rows.join(F.broadcast(before), "part").select("doc_id", (F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def query(spark, sf_dir: str) -> DataFrame:
    return locate(encode(spark.read.parquet(f"{sf_dir}/documents.parquet")))
