"""Every registered query with SQL gives the same rows as DuckDB over the same tables."""

import __spark_entry__ as entry
import duckdb
import pandas as pd
import pytest

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = df[c].map(lambda x: "null" if x is None or (not isinstance(x, str) and pd.isna(x)) else f"{x:.9g}" if isinstance(x, float) else str(x))
    return sorted(df.itertuples(index=False, name=None)), sorted(df.columns)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows(spark, duck, sf_dir, name):
    got = plain(entry.queries()[name](spark, sf_dir).toPandas())
    want = plain(duck.execute(entry.oracle_sql()[name]).df())
    assert got[1] == want[1]
    assert got[0] == want[0]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
