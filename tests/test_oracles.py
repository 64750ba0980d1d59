"""Every registered query with SQL returns what DuckDB returns for that SQL."""

import duckdb
import pytest

from corpusloom.plans.queries import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for t in TABLES.split():
        c.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", QUERIES)
def test_query(name, spark, data, con):
    df = QUERIES[name](spark, data)
    columns = sorted(df.columns)
    got = [tuple(r) for r in df.select(columns).collect()]
    if name not in SQL:
        assert got
        return
    want = con.sql(SQL[name])
    assert sorted(want.columns) == columns
    key = lambda rows: sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)
    assert key(got) == key(want.select(*columns).fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
