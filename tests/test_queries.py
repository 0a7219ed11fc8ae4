"""Every query with SQL gives the rows that DuckDB gives; the others run and have a stable schema."""

import duckdb
import pytest

from lumenquery.plans import registry
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canon(v):
    return repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_rows_equal_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    mine = sorted(tuple(canon(r[c]) for c in cols) for r in df.collect())
    cur = duck.execute(registry.oracles()[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert mine == sorted(tuple(canon(r[i]) for i in at) for r in cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracles())))
def test_rows_only(spark, name):
    a, b = registry.queries()[name](spark, SF), registry.queries()[name](spark, SF)
    assert a.schema == b.schema
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
