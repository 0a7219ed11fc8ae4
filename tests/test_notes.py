"""Markdown notes as a source, and atoms with their groups."""

import tempfile

import pytest
from pyspark.sql import functions as F

from lumenquery.operators import notes as N
from lumenquery.operators import topk as K
from lumenquery.sources.journal import Journal


def test_notes_are_scanned_and_upserted(spark):
    d = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    put = lambda name, text: open(f"{d}/{name}", "w").write(text)  # noqa: E731, SIM115
    put("a.md", "# Notes\n\n### k1\n- score: 3\n- why:  far: out \nfree text\n\n### k2\n### \n- x: 1\n### k1\n- score: 4\n- score: 5\n")
    put("b.md", "### k3\n- score: 1")
    scan = lambda: {r.key: r.fields for r in N.scan(spark, f"file://{d}").collect()}
    assert scan() == {"k1": {"score": "5"}, "k2": {}, "k3": {"score": "1"}}
    j = Journal(spark, f"file://{d}/store")
    go = lambda: N.upsert(j, N.scan(spark, f"file://{d}/*.md"))
    assert go() == {"added": 3, "changed": 0, "unchanged": 0} and go() == {"added": 0, "changed": 0, "unchanged": 3} and j.version() == 1
    put("c.md", "### k1\n- score: 9\n### k4\n- a: b")
    assert go() == {"added": 1, "changed": 1, "unchanged": 2}
    assert {r.key: (r.fields.get("score"), r.batch) for r in N.current(j).collect()} == {"k1": ("9", 2), "k2": (None, 1), "k3": ("1", 1), "k4": (None, 2)}
    assert {r.key: r.batch for r in N.current(j, 1).collect()} == {"k1": 1, "k2": 1, "k3": 1}


def test_a_note_reads_back(spark):
    d = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    df = spark.createDataFrame([("a", "one\ntwo", None), ("b", "", "x: y")], "k string, t string, u string")
    df.select(N.section(F.col("k"), {"t": F.col("t"), "u": F.col("u")}).alias("value")).write.text(f"file://{d}/n")
    assert {r.key: r.fields for r in N.scan(spark, f"file://{d}/n").collect()} == {"a": {"t": "one two"}, "b": {"t": "", "u": "x: y"}}


def test_atoms(spark):
    atoms = lambda *i: spark.createDataFrame([(x, "t") for x in i], "atom_id int, text string")
    groups = lambda *g: spark.createDataFrame([(list(x),) for x in g], "members array<int>")
    assert {r.atom_id: r.group_id for r in N.grouped_atoms(atoms(1, 2, 3, 4), groups([3, 2], [4, 4])).collect()} == {1: 1, 2: 2, 3: 2, 4: 4}
    for a, g, what in ((atoms(1, 1), groups(), "repeated"), (atoms(1), groups([1, 2]), "unknown"), (atoms(1, 2, 3), groups([1, 2], [2, 3]), "several")):
        with pytest.raises(Exception, match=what):
            N.grouped_atoms(a, g).collect()


def test_families_and_expansion(spark):
    asked = spark.createDataFrame([(1, "sailing", 2), (1, "boat", 1), (2, "sailors", 1)], "question int, term string, times int")
    df = spark.createDataFrame([("sailing", 9), ("sailors", 5), ("sailor", 7), ("sailcloth", 3), ("sailo", 4), ("sailorx", 1), ("sailored", 5)], "term string, df int")
    fam = {}
    for r in K.families(asked, df, 5, 2).collect():
        fam.setdefault(r.cue, []).append(r.term)
    assert {k: sorted(v) for k, v in fam.items()} == {"sailors": ["sailor", "sailored"]}
    got = {(r.question, r.term): r.times for r in K.expanded(asked, spark.createDataFrame([("sailors", "sailor"), ("sailing", "sailing"), ("boat", "ship")], "cue string, term string"), 3.5).collect()}
    assert got == {(1, "sailing"): 3.5, (1, "boat"): 1.0, (1, "ship"): 3.5, (2, "sailors"): 1.0, (2, "sailor"): 3.5}
