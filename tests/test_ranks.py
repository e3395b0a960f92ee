"""Quantiles in their default form, where groups are larger than what a sketch keeps of them."""

from __future__ import annotations

import math
from fractions import Fraction

import duckdb
import pytest

from lattica import service_queries
from lattica.engine import Engine


def test_registered_query_agrees_with_its_sql_on_large_groups(spark, tmp_path):
    lines = spark.range(0, 400_000, 1, 8).selectExpr("cast(id % 3 as int) as l_linenumber", "id * 7919 % 400009 as l_suppkey")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    found = service_queries.quantile_default(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, found)) == sorted(con.execute(service_queries.ORACLE_SQL["quantile_default"]).fetchall())


QUANTILES = ("0.", "0.07", "0.5", "0.9999", "1.")
#: Name: rows, value by the row's number i.
GROUPS = {
    "one": (1, "cast(i as double)"),
    "hundred": (100, "cast(i as double)"),
    "limit": (10_000, "cast(i * 37 % 10007 as double)"),
    "over": (10_001, "cast(i * 37 % 10007 as double)"),
    "spread": (120_000, "(i * 7919 % 120011) * 0.5 - 20000"),
    "sorted": (120_000, "cast(i as double)"),
    "ties": (120_000, "cast(i * 7919 % 120011 % 4 as double)"),
    "skewed": (120_000, "exp(cast(i * 7919 % 120011 as double) / 300.0)"),
    "nan": (30_000, "if(i % 10 < 4, double('NaN'), cast(i * 7919 % 30011 as double))"),
    "infinite": (30_000, "case when i % 10 < 3 then double('NaN') when i % 10 < 7 then double('Infinity') else double(i) end"),
}


def _of(values: list[float], q: str) -> float:
    ordered = sorted(values, key=lambda x: (math.isnan(x), x if x == x else 0.0))
    found = ordered[max(1, math.ceil(Fraction(q + "0") * len(values))) - 1]
    return -1.0 if math.isnan(found) else found


def test_default_quantiles_have_the_rank_itself(spark):
    df = None
    for name, (n, x) in GROUPS.items():
        part = spark.range(0, n, 1, 8).withColumnRenamed("id", "i").selectExpr(f"'{name}' as g", f"{x} as x", "i * 7919 % 120011 as k", "double('NaN') as z")
        df = part if df is None else df.union(part)
    df = df.cache()
    e = Engine(spark)
    e.catalog.register("q", df)
    values = {}
    for g, x, k, _ in df.collect():
        values.setdefault(g, ([], []))[0].append(x)
        values[g][1].append(k)
    statement = f"select g, count(), qvc(k), {', '.join(f'quantile({q}, x), quantile({q}, k)' for q in QUANTILES)} from q group by g, z"
    found = {r[0]: tuple(r)[1:] for r in e.sql(statement).collect()}
    assert found.keys() == values.keys()
    for g, (x, k) in values.items():
        low, high = _of(k, "0.25"), _of(k, "0.75")
        assert found[g][:2] == (len(x), (high - low) / (high + low) if high + low else -1.0), g
        assert found[g][2:] == tuple(v for q in QUANTILES for v in (_of(x, q), float(_of(k, q)))), g
    df.unpersist()


def test_quantiles_order_and_filter_groups(spark):
    e = Engine(spark)
    e.catalog.register("q", spark.range(0, 90_000, 1, 6).selectExpr("id % 3 as g", "id as x"))
    found = e.sql("select g, add(quantile(0.5, x), 0.5) from q group by g having quantile(0.5, x) > 44997. order by quantile(0.5, x) desc").collect()
    assert list(map(tuple, found)) == [(2, 44999.5), (1, 44998.5)]


def test_bounds_that_miss_the_rank_are_an_error(spark, monkeypatch):
    from lattica.operators import ranks

    monkeypatch.setattr(ranks, "MARGIN", -0.1)
    e = Engine(spark)
    e.catalog.register("q", spark.range(0, 30_000).selectExpr("id as x", "'a' as g"))
    with pytest.raises(Exception, match="bounds of a quantile"):
        e.sql("select quantile(0.5, x) from q group by g").collect()
