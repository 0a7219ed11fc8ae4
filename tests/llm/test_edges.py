"""Names that clash, tables that are empty, archives of other writers, long texts, raking by hand, a model on rows that it hasn't seen."""

import base64
import gzip
import hashlib
import math
import os
import random
import tempfile
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenquery.llm import op1_secrets, op2_quality, op4_mixing, op6_warc, op7_sentencepiece, op8_jaccard, op9_topk, op10_suffix_dedup

CLASHES = "p factor tokens weight key base weak linked assign access hex id class fp comp quality __quality __key mix_p mix_sampled cell_lang n_units n_pieces round_trip ids whole".split()
NAMED = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)


@pytest.fixture(scope="module")
def named(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    rng = random.Random(2)
    text = [" ".join(rng.choices(words, k=40)) for _ in range(8)]
    text += [text[0], text[1] + " tail", None, "", 'token = "abcdefgh12345678" end']
    rows = [(i, t, rng.choice(["en", None]), "s", len(t or ""), *CLASHES) for i, t in enumerate(text)] + [(3, text[3], "en", "s", 1, *CLASHES), (None, text[4], None, None, None, *CLASHES)]
    return spark.createDataFrame(rows, NAMED)


def same_columns(out, docs):
    assert out.columns == docs.columns
    for r in out.collect():
        assert all(r[c] == c for c in CLASHES)


def test_clashing_names(spark, named):
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, quality int")
    same_columns(op1_secrets.redact(named), named)
    assert op1_secrets.redact(named).where("contains(text, '[secret]')").count() == 1
    kept = op2_quality.keep(named, labels)
    same_columns(kept, named)
    with pytest.raises(ValueError):
        op2_quality.judge(named, None)
    same_columns(op4_mixing.sample(named), named)
    mixed = op4_mixing.mix(named, keep=1.0)
    assert len(set(mixed.columns)) == len(mixed.columns) and mixed.count() == named.count()
    one = op8_jaccard.keep_one(named, 5, 80)
    same_columns(one, named)
    encoded = op7_sentencepiece.encode(named, keep=tuple(named.columns))
    assert len(set(encoded.columns)) == len(encoded.columns)
    assert encoded.where("not _round_trip").count() == 0


def test_near_duplicates_by_hand(named):
    rows = [(r.doc_id, r.text) for r in named.select("doc_id", "text").collect()]
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    near = lambda a, b: bool(a) and bool(b) and 100 * len(a & b) >= 80 * len(a | b)
    group = list(range(len(rows)))
    for _ in rows:
        group = [min(group[j] for j in range(len(rows)) if i == j or near(sets[i], sets[j])) for i in range(len(rows))]
    want = len({g for g, s in zip(group, sets, strict=True) if s}) + sum(not s for s in sets)
    assert op8_jaccard.keep_one(named, 5, 80).count() == want


def test_empty_tables(spark, named):
    import corpus_pipeline

    empty, sf = named.limit(0), tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0, name
    for name, stage in corpus_pipeline.STAGES[:-1]:  # no labels: only the base rules reject
        out = stage(spark, named, sf)
        assert out.columns == named.columns, name
    assert op7_sentencepiece.decode(op7_sentencepiece.encode(empty.select("doc_id", "text"))).count() == 0


def test_round_trip_tells(spark):
    rows = [(1, "a▁b"), (2, "a b"), (3, " a  b "), (4, "▁"), (5, "a▁ b▁"), (6, None)]
    got = {r.doc_id: r for r in op7_sentencepiece.decode(op7_sentencepiece.encode(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    for d, t in rows:
        assert got[d].round_trip == (got[d].text == (t or "")), t


def member(head: str, block: bytes) -> bytes:
    return gzip.compress(head.replace("\n", "\r\n").encode() + b"\r\n" + block + b"\r\n\r\n")


def test_archives_of_others(spark):
    body, page = b"<html>hello</html>", b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"
    sha = base64.b32encode(hashlib.sha1(body).digest()).decode()
    info = b"software: x\r\nformat: WARC File Format 1.1\r\n"
    parts = [
        member(f"WARC/1.1\nWARC-Type: warcinfo\nWARC-Date: 2024-01-01T00:00:00Z\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\nContent-Type: application/warc-fields\nContent-Length: {len(info)}\n", info),
        member(f"WARC/1.0\nwarc-type:response\nwarc-target-uri: https://a/\n b\nWARC-Payload-Digest: sha1:{sha}\nContent-Type: application/http; msgtype=response\ncontent-length:{len(page + body)}\n", page + body),
        member("WARC/1.1\nWARC-Type: resource\nContent-Type: text/plain\nContent-Length:   5\n", b"plain"),
        member(f"WARC/1.1\nWARC-Type: revisit\nWARC-Payload-Digest: sha1:{sha}\nContent-Type: application/http\nContent-Length: {len(page)}\n", page),
    ]
    path = os.path.join(tempfile.mkdtemp(prefix="spark-", dir="/tmp"), "other.warc.gz")
    with open(path, "wb") as f:
        f.write(b"".join(parts))
    manifest = spark.createDataFrame([(f"file://{path}", os.path.getsize(path))], "uri string, size long")
    for split in (50, 1 << 20):
        got = {r.record_type: r for r in op6_warc.read(manifest, split).collect()}
        assert set(got) == {"warcinfo", "response", "resource", "revisit"} and all(r.intact for r in got.values())
        assert (got["response"].payload_bytes, got["response"].payload_digest, got["response"].url) == (len(body), hashlib.sha1(body).hexdigest(), "https://a/ b")
        assert got["resource"].payload_bytes == 5 and got["revisit"].payload_bytes is None and got["revisit"].page_id is None


def test_op4_rakes_as_by_hand(spark):
    rng = random.Random(4)
    rows = [(i, "word " * rng.randint(1, 300) + rng.choice(["", " | ", "@"]), rng.choice(["en", "de"]), rng.choice(["a", "a", "a", "b"])) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    topic = lambda t: "tables" if " | " in t else "contact" if "@" in t else "notes" if len(t) < 600 else "prose"
    cells = {}
    for _, t, lang, source in rows:
        cells[source, lang, topic(t)] = cells.get((source, lang, topic(t)), 0) + len(t.split())
    topics = sorted({k[2] for k in cells})
    want = [{"a": 0.5, "b": 0.5}, {"en": 0.7, "de": 0.3}, {t: 1 / len(topics) for t in topics}]
    w = {k: float(v) for k, v in cells.items()}
    for _ in range(400):
        for axis in range(3):
            total = {v: sum(x for k, x in w.items() if k[axis] == v) for v in want[axis]}
            w = {k: x * want[axis][k[axis]] / total[k[axis]] for k, x in w.items()}
    targets = spark.createDataFrame([(a, v, s) for a, m in zip(op4_mixing.AXES, want, strict=True) for v, s in m.items()], "axis string, value string, share double")
    got = {}
    for r in op4_mixing.mix(docs, targets, keep=0.2).collect():
        got[r.source, r.lang, r.mix_topic] = got.get((r.source, r.lang, r.mix_topic), 0.0) + r.mix_weight
    assert set(got) == set(w)
    for k in w:
        assert abs(got[k] - w[k]) < 1e-4, k
    for axis in range(3):
        for v, s in want[axis].items():
            assert abs(sum(x for k, x in got.items() if k[axis] == v) - s) < 1e-4


def test_op10_over_a_chunk(spark):
    rng = random.Random(6)
    make = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    shared, length = make(90_000), 400
    rows = [(1, make(500) + shared + make(70_000)), (2, make(10) + shared[100:89_000] + make(300)), (3, make(140_000)), (None, shared[65_000:66_000])]
    got = {r.doc_id: r for r in op10_suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), length).collect()}
    seen = {}
    for i, (_, t) in enumerate(rows):
        for a in range(len(t) - length + 1):
            seen.setdefault(hash(t[a : a + length]), []).append((i, a))
    for i, (d, t) in enumerate(rows):
        edge = np.zeros(len(t) + 1, int)
        for places in seen.values():
            if len(places) > 1:
                for j, a in places:
                    if j == i:
                        edge[a] += 1
                        edge[a + length] -= 1
        gone = np.cumsum(edge)[:-1] > 0
        assert (got[d].n_removed, got[d].kept_sha256) == (int(gone.sum()), hashlib.sha256(np.frombuffer(t.encode(), np.uint8)[~gone].tobytes()).hexdigest()), d


def test_op2_on_rows_it_has_not_seen(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = op2_quality.train(docs, labels.where("doc_id % 2 = 0"))
    rated = op2_quality.judge(docs, model).join(labels.where("doc_id % 2 = 1"), "doc_id")
    right = rated.agg(F.avg(((F.col("__quality.bad_probability") > 0.5) == (F.col("quality") == 0)).cast("int"))).first()[0]
    assert right >= 0.8, right


def brute_topk(rows):
    v = {i: [math.floor(256 * c) for c in x] for i, x in rows if x and all(c is not None and math.isfinite(c) for c in x)}
    score = lambda a, b: sum(x * y for x, y in zip(v[a], v[b], strict=False))
    return {(q, k, i, -s) for q in v if q % 50 == 0 for k, (s, i) in enumerate(sorted((-score(q, i), i) for i in v if i != q)[:5], 1)}


@pytest.mark.parametrize("size", [1.0, 300.0, 7e4, 2e6])
def test_op9_components_of_any_size(spark, size):
    """Beyond 2**53 sums of doubles lose bits; results stay exact."""
    rng = np.random.default_rng(3)
    rows = [(i, (size * rng.normal(size=24)).tolist()) for i in range(160)] + [(400, [size, 0.5]), (450, [size + 1 / 256, 0.5]), (451, [size, 0.5]), (452, [float("nan")]), (453, [float("inf")]), (454, None), (455, [])]
    got = [tuple(r) for r in op9_topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()]
    assert set(got) == brute_topk(rows) and len(got) == 6 * 5


def test_op9_small_and_large_vectors_together(spark):
    rows = [(0, [70000.0, 1.0]), (1, [70000.0, 2.0]), (50, [1.0, 1.0]), (100, [80000.0, 1.0]), (101, [-1e30, 0.0]), (102, [-1e200, 0.0]), (103, [2.0]), (104, [3.0]), (105, [0.0])]
    got = {tuple(r) for r in op9_topk.search(spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "vec_id long, embedding array<double>, score int, rank string, v long")).collect()}
    assert got == brute_topk(rows)
    with pytest.raises(Exception, match="beyond a long"):
        op9_topk.search(spark.createDataFrame([(0, [1e30]), (1, [1e30])], "vec_id long, embedding array<double>")).collect()


def test_op9_many_dimensions_and_repeated_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=300).tolist()) for i in range(120)] + [(150, [2.0] * 300), (150, [2.0] * 300)]
    got = [tuple(r) for r in op9_topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()]
    assert set(got) == brute_topk(rows) and len(got) == 20
    assert op9_topk.search(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0
