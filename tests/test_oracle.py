"""Every registered statement against DuckDB on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from lattica import queries

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in queries.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_same_rows(spark, duck, name):
    mine = queries.QUERIES[name](spark, SMALL).toPandas()
    other = duck.execute(queries.ORACLE_SQL[name]).df()
    columns = sorted(mine.columns)
    assert columns == sorted(other.columns)
    mine, other = (x[columns].sort_values(columns).reset_index(drop=True) for x in (mine, other))
    assert len(mine) == len(other)
    for c in columns:
        assert mine[c].dtype == other[c].dtype
        assert (mine[c].to_numpy() == other[c].to_numpy()).all()
