"""Every registered query with SQL against DuckDB on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from quillon.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canonical(df):
    def cell(x):
        if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x):
            return "NULL"
        return f"{x:.6f}" if isinstance(x, float) else str(x)

    return sorted(tuple(cell(x) for x in row) for row in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = registry.QUERIES[name](spark, SF).toPandas(), duck.execute(registry.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = canonical(got), canonical(want)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert x == y or all(p == q or abs(float(p) - float(q)) < 1e-5 for p, q in zip(x, y))


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0
