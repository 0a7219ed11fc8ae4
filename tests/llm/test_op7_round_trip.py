"""op7's round_trip is told by decoding: ids that spell another text are noticed, and so is a text with \u2581."""

import numpy as np

from lumenquery.llm import op7_sentencepiece as op7
from lumenquery.llm.files import write_bytes


def test_op7_round_trip_decodes(spark, monkeypatch):
    texts = ["the boat", "the other", "a \u2581 b", "", None, "\u7684\u1234 \U0001f600\r\n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    assert {r.doc_id: r.round_trip for r in op7.encode(docs).collect()} == {i: i != 2 for i in range(6)}
    made = op7.train_free_model

    def spoiled(docs, path):
        """The path of "\u2581boat" spells something else."""
        files, pieces = [], op7.vocabulary(path)[0]
        h, _ = op7.hashes_of(["\u2581boat"])
        for shard, uri, n, n_ids in made(docs, path):
            raw = np.array(op7.mapped(uri, np.uint8))
            keys, offsets, ids = raw[: 8 * n].view(np.uint64), raw[16 * n : 24 * n + 8].view(np.int64), raw[24 * n + 8 :].view(np.int32)
            for i in np.flatnonzero(keys == h[0]):
                ids[offsets[i]] = pieces.index("\u2581ship")
            files.append((shard, write_bytes(uri.rsplit("/", 1)[0], "spoiled", [raw.tobytes()]), n, n_ids))
        return files

    monkeypatch.setattr(op7, "train_free_model", spoiled)
    assert {r.doc_id: r.round_trip for r in op7.encode(docs).collect()} == {i: i not in (0, 2) for i in range(6)}
