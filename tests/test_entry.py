"""Driver queries against DuckDB over the smallest tables."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def without_marks(column):
    """Nulls as such, and whole numbers beside them as what they were; each library has marks of its own."""
    if not column.isna().any():
        return column
    return pd.Series([None if pd.isna(x) else int(x) if isinstance(x, float) and x.is_integer() else x for x in column], dtype=object)


def rows(df):
    df = pd.DataFrame({c: without_marks(df[c]) for c in sorted(df.columns)})
    return sorted(repr(tuple(x.item() if hasattr(x, "item") else x for x in r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_oracle(spark, oracle, name):
    got, wanted = entry.queries()[name](spark, SF).toPandas(), oracle.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(wanted.columns)
    assert rows(got) == rows(wanted)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
