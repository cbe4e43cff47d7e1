"""Every registered query of the engine against its SQL."""

import duckdb
import pandas as pd
import pytest

from tests.conftest import DATA
from tidemark.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def same(a: pd.DataFrame, b: pd.DataFrame) -> None:
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    a, b = (x[columns].sort_values(columns, ignore_index=True) for x in (a, b))
    assert len(a) == len(b)
    for c in columns:
        if pd.api.types.is_numeric_dtype(a[c]) and pd.api.types.is_numeric_dtype(b[c]):
            assert ((a[c].astype(float) - b[c].astype(float)).abs() < 1e-9).eq(True).where(a[c].notna() | b[c].notna(), True).all(), c
        else:
            assert (a[c].astype(str) == b[c].astype(str)).all(), c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, duck, name):
    same(QUERIES[name](spark, DATA).toPandas(), duck.sql(ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql(spark, name):
    rows = QUERIES[name](spark, DATA).toPandas()
    again = QUERIES[name](spark, DATA).toPandas()
    columns = list(rows.columns)
    assert rows.sort_values(columns, ignore_index=True).equals(again.sort_values(columns, ignore_index=True))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(ORACLE_SQL) <= set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
