"""The operators that SQL can express give the rows that DuckDB gives."""

import duckdb
import pytest

from lumenquery.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_rows_equal_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    cur = con.execute(queries.ORACLES[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == sorted(df.columns)
    mine = sorted(str([r[c] for c in names]) for r in df.collect())
    assert mine == sorted(str(list(r)) for r in cur.fetchall())
