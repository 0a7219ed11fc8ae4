"""table_digest against a plain loop: an ordered chain of every row's hash."""

import hashlib

import duckdb

from lumenquery.plans import registry, text_queries


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_table_digest_chains_all_rows_in_order(spark, tmp_path):
    rows = [(i * 37 + i % 3, "ab"[i % 2], None if i % 41 == 0 else f"text {i % 17}") for i in range(900)]
    rows += [(5, "a", "twice"), (5, "a", "again"), (None, "b", "no id"), (12_345_678_901, "b", "far"), (7, None, "no source")]
    schema = "doc_id long, source string, text string"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for source in ("a", "b", None):
        level = [(i, sha(f"{'' if i is None else i}:{'' if t is None else hashlib.md5(t.encode()).hexdigest()}"), 1) for i, s, t in rows if s == source]
        order = lambda x: (x[0] is None, x[0] or 0, x[1])
        for _ in range(4):
            blocks = {}
            for i, h, n in sorted(level, key=order):
                blocks.setdefault(None if i is None else i // 100, []).append((h, n))
            level = [(b, sha("".join(h for h, _ in x)), sum(n for _, n in x)) for b, x in blocks.items()]
        want[source] = sha("".join(h for _, h, _ in sorted(level, key=order))), sum(n for _, _, n in level)
    got = {r.source: (r.digest, r.n) for r in text_queries.table_digest(spark, str(tmp_path)).collect()}
    assert got == want
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert {s: (h, n) for s, h, n in con.execute(registry.oracles()["table_digest"]).fetchall()} == want
