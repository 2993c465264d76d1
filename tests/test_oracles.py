"""Every core query against its SQL in DuckDB, at the smallest size."""

import duckdb
import pytest

from tracewell.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df):
    df = df[sorted(df.columns)].astype(object).where(df.notna(), None)
    show = lambda x: repr(round(float(x), 9)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)
    return sorted(tuple(map(show, r)) for r in df.itertuples(index=False))


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    found, expected = registry.QUERIES[name](spark, SF).toPandas(), con.execute(registry.ORACLE_SQL[name]).df()
    assert sorted(found.columns) == sorted(expected.columns)
    assert rows(found) == rows(expected)


def test_every_sql_has_a_query():
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)
