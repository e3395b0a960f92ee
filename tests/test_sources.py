from __future__ import annotations

import json
import re

import pytest

from lattica import cli
from lattica.engine import Engine
from lattica.errors import LoadError, ValidationError
from lattica.operators.slices import Slice, slice_text, with_order
from lattica.plans.parser import parse
from lattica.plans.tree import quote, render
from lattica.sources import ingest
from lattica.sources.deploy import TRIES, Deployment, parse_descriptor
from lattica.sources.schema import Field


def put(path, value):
    path.write_text(value if isinstance(value, str) else json.dumps(value))
    return str(path)


def test_json_gets_value_types_and_defaults(spark, tmp_path):
    path = put(tmp_path / "a.json", [{"a": 1, "b": [{"c": 1}, {"d": "x"}], "t": True}, {"b": None, "e": 1.5}])
    df = ingest.read_json(spark, path)
    assert {f.name: f.dataType.simpleString() for f in df.schema} == {"a": "bigint", "b": "array<struct<c:bigint,d:string>>", "e": "double", "t": "bigint"}
    found = [r.asDict(True) for r in df.orderBy("a").collect()]
    assert found == [{"a": -1, "b": [], "e": 1.5, "t": -1}, {"a": 1, "b": [{"c": 1, "d": ""}, {"c": -1, "d": "x"}], "e": 0.0, "t": 1}]


def test_json_types(spark, tmp_path):
    path = put(tmp_path / "a.json", [{"a": 1, "s": "x", "d": 1.5}])
    assert ingest.read_json(spark, path, {"a": "string"}).first()["a"] == "1"
    for types in ({"s": "long"}, {"d": "long"}, {"a": "date"}):
        with pytest.raises(LoadError):
            ingest.read_json(spark, path, types)
    with pytest.raises(LoadError, match="multi-dimensional"):
        ingest.read_json(spark, put(tmp_path / "b.json", [{"a": [[1]]}]))


def test_csv(spark, tmp_path):
    path = put(tmp_path / "a.csv", "a,b,c\n1,2.5,x\n,,\n3,1,last")
    df = ingest.read_csv(spark, path, {"a": "long", "b": "DOUBLE"})
    assert sorted(tuple(r) for r in df.collect()) == [(-1, 0.0, ""), (1, 2.5, "x"), (3, 1.0, "last")]
    assert ingest.read_csv(spark, path).first()["a"] == "1"
    with pytest.raises(Exception, match="not a LONG"):
        ingest.read_csv(spark, path, default_type="LONG").collect()
    with pytest.raises(LoadError):
        ingest.read_csv(spark, path, {"q": "LONG"})


def test_parts_of_a_table_must_agree(spark):
    e = Engine(spark)
    e.catalog.add("t", spark.createDataFrame([(1,)], "width int"))
    e.catalog.add("t", spark.createDataFrame([("x", [1])], "label string, r array<long>"))
    assert e.catalog.fields("t") == [Field("width", "LONG", False), Field("label", "STRING", False), Field("r", "LONG", True)]
    assert sorted(tuple(r) for r in e.sql("select width, label, r[length] from t").collect()) == [(-1, "x", 1), (1, "", 0)]
    with pytest.raises(LoadError, match="label"):
        e.catalog.add("t", spark.createDataFrame([(1,)], "label long"))
    with pytest.raises(LoadError, match="r is repeated"):
        e.catalog.add("t", spark.createDataFrame([(1,)], "r long"))


def test_nested_fields_are_united(spark):
    a = spark.createDataFrame([([(1,)],)], "a array<struct<x:long>>")
    b = spark.createDataFrame([([("y",)],)], "a array<struct<y:string>>")
    found = [r.asDict(True) for r in ingest.union([a, b]).collect()]
    assert found == [{"a": [{"x": 1, "y": ""}]}, {"a": [{"x": -1, "y": "y"}]}]


def test_types_without_a_value_type(spark):
    with pytest.raises(LoadError):
        Engine(spark).catalog.register("t", spark.sql("select map(1, 2) as m"))


def test_write_info_merge(spark, tmp_path):
    put(tmp_path / "a.json", [{"a": 1}, {"a": 2}])
    put(tmp_path / "b.csv", "b\nx\n")
    cli.main(["transpose", "-i", str(tmp_path / "a.json"), "-o", str(tmp_path / "a"), "-t", "json", "-c", "first"], spark)
    cli.main(["transpose", "-i", str(tmp_path / "b.csv"), "-o", str(tmp_path / "b"), "-t", "csv"], spark)
    cli.main(["merge", "-i", str(tmp_path / "a"), str(tmp_path / "b"), "-o", str(tmp_path / "m")], spark)
    found = ingest.info(spark, str(tmp_path / "a"))
    assert (found["rows"], found["comment"], found["fields"]) == (2, "first", [("a", "LONG", False)])
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "m")).collect()) == [(-1, "x"), (1, ""), (2, "")]


def test_row_builder(spark):
    row = ingest.RowBuilder().with_data("a", 1).add_repeated("r", 1, 2).add_repeated("o", ingest.RowBuilder().with_data("x", "y")).build()
    assert row == {"a": 1, "r": [1, 2], "o": [{"x": "y"}]}
    with pytest.raises(LoadError):
        ingest.RowBuilder().add_repeated("r", 1, "x")
    with pytest.raises(LoadError):
        ingest.RowBuilder().with_data("a", None)


def test_deployment(spark, tmp_path):
    put(tmp_path / "stock.json", [{"shelf": 8, "r": [4, 6]}, {"shelf": 8, "r": [1]}, {"shelf": 2}])
    (tmp_path / "stock.control").write_text("# what is there\nfile=stock.json\ntype=json\ntable=stock\nfirstRowId=0\nautoFlatten=r[*]\n")
    (tmp_path / "bad.control").write_text("file=nowhere.json\ntype=json\ntable=bad\n")
    e = Engine(spark)
    d = Deployment(e.catalog, str(tmp_path))
    d.scan()
    assert e.catalog.tables() == ["stock"]
    assert (tmp_path / "stock.ready").exists() and (tmp_path / "bad.failure").read_text()
    assert [tuple(r) for r in e.sql("select shelf, count() from stock group by shelf order by shelf").collect()] == [(2, 1), (8, 2)]
    assert [tuple(r) for r in e.sql("select sum(r) from flatten(stock, r[*]) group by id(shelf)").collect()] == [(11,)]
    (tmp_path / "stock.control").unlink()
    d.scan()
    assert e.catalog.tables() == [] and not (tmp_path / "stock.ready").exists()


def test_descriptors_are_tried_again(spark, tmp_path):
    e = Engine(spark)
    d = Deployment(e.catalog, str(tmp_path))
    (tmp_path / "late.control").write_text("file=late.json\ntype=json\ntable=late\n")
    d.scan()
    assert (tmp_path / "late.failure").exists()
    put(tmp_path / "late.json", '{"a": 1}\n{"a": 2}\n')
    d.scan()
    assert e.catalog.tables() == ["late"] and not (tmp_path / "late.failure").exists()
    (tmp_path / "never.control").write_text("file=never.json\ntype=json\ntable=never\n")
    for _ in range(TRIES + 2):
        d.scan()
    assert d._failed[tmp_path / "never.control"][1] == TRIES


def test_json_with_an_object_a_line(spark, tmp_path):
    lines = put(tmp_path / "l.json", '\n  {"a": 1}\n{"a": 2, "b": "x"}\n{"b": null}\n')
    assert sorted(tuple(r) for r in ingest.read_json(spark, lines).collect()) == [(-1, ""), (1, ""), (2, "x")]
    spread = put(tmp_path / "s.json", '{\n "a": 5\n}')
    array = put(tmp_path / "a.json", '[\n {"a": 7},\n {"a": 8}\n]')
    assert sorted(r["a"] for r in ingest.read_json(spark, [lines, spread, array]).collect()) == [-1, 1, 2, 5, 7, 8]


def test_filters_and_columns_reach_the_files_of_each_part(spark, tmp_path):
    e = Engine(spark)
    for k, kind in enumerate(("int", "long")):
        spark.createDataFrame([(k, 2, [(1, "3")])], f"a {kind}, b long, c array<struct<x:long,z:string>>").write.parquet(str(tmp_path / str(k)))
        e.catalog.load("p", "parquet", str(tmp_path / str(k)))
    found = e.sql("select sum(c[*].x) from p where a > 0 and b = 2")._jdf.queryExecution().executedPlan().toString()
    assert found.count("GreaterThan(a,0)") == 2 and found.count("EqualTo(b,2)") == 2
    assert "struct<a:int,b:bigint,c:array<struct<x:bigint>>>" in found and "struct<a:bigint,b:bigint,c:array<struct<x:bigint>>>" in found


def test_two_level_flatten_reads_only_what_is_named(spark, tmp_path):
    rows = [([(1, 9, [(5, "x", 0.5), (6, "y", 1.5)]), (2, 8, [(7, "z", 2.5)]), (3, 7, None)], "u")]
    for k in range(2):
        spark.createDataFrame(rows, "a array<struct<e:long,g:long,b:array<struct<c:long,s:string,d:double>>>>, w string").write.parquet(str(tmp_path / str(k)))
    e = Engine(spark)
    e.catalog.load("t", "parquet", str(tmp_path / "0"))
    schema = lambda text: re.findall(r"ReadSchema: (\S+)", e.sql(text)._jdf.queryExecution().executedPlan().toString())
    assert schema("select a.b.c, count() from flatten(t, a[*].b[*]) group by a.b.c") == ["struct<a:array<struct<b:array<struct<c:bigint>>>>>"]
    assert schema("select a.e, a.b.d from flatten(t, a[*].b[*]) where a.b.s = 'x'") == ["struct<a:array<struct<e:bigint,b:array<struct<s:string,d:double>>>>>"]
    assert sorted(tuple(r) for r in e.sql("select a.e, a.b.c from flatten(t, a[*].b[*])").collect()) == [(1, 5), (1, 6), (2, 7)]
    assert sorted(tuple(r) for r in e.sql("select a.e, a.b[length] from flatten(t, a[*])").collect()) == [(1, 2), (2, 1), (3, 0)]
    e.catalog.load("t", "parquet", str(tmp_path / "1"))
    assert len(schema("select a.b.c, count() from flatten(t, a[*].b[*]) group by a.b.c")) == 2
    assert sorted(tuple(r) for r in e.sql("select a.b.c, count() from flatten(t, a[*].b[*]) group by a.b.c").collect()) == [(5, 2), (6, 2), (7, 2)]
    with pytest.raises(ValidationError, match="no column"):
        e.sql("select a.q from flatten(t, a[*])")


def test_files_of_bounded_size(spark, tmp_path):
    ingest.write(spark.range(20_000).coalesce(1), str(tmp_path / "w"), file_mb=0.05)
    assert len(list((tmp_path / "w").glob("*.parquet"))) > 3 and spark.read.parquet(str(tmp_path / "w")).count() == 20_000


def test_flattened_tables_are_bounded(spark):
    e = Engine(spark)
    for name in ("a", "b"):
        e.catalog.register(name, spark.createDataFrame([([1, 2],)], "r array<long>"))
        e.prepare_flatten(name, "r[*]")
    assert len(e.catalog._flat) == 2
    e.catalog.flat_mb = 0.0
    e.catalog.register("c", spark.createDataFrame([([1, 2],)], "r array<long>"))
    e.prepare_flatten("c", "r[*]")
    assert ("c", "r[*]") not in e.catalog._flat
    assert e.sql("select sum(r) from flatten(c, r[*]) group by id(string(r))").count() == 2


@pytest.mark.parametrize("value", [1e-20, 1e300, -2.5, 0.1, "a\\", "it's \\' so", "\\\\", "", 5, -7])
def test_literals_parse_back(value):
    text = f"select a from t where a = {quote(value)}"
    assert parse(text).where.right.value == value
    assert parse(render(parse(text))) == parse(text)


@pytest.mark.parametrize("text", ["type=json\ntable=t", "file=a\ntype=avro\ntable=t", "file=a\ntype=csv", "nonsense", "file=a\ntype=csv\ntable=t\nother=1", "file=a\ntype=csv\ntable=t\nfirstRowId=x"])
def test_bad_descriptors(text):
    with pytest.raises(LoadError):
        parse_descriptor(text)


def test_slices():
    s = Slice((("a", (1, 2)), ("b.c", ("x'y",)), ("e", ())), "d > 1.")
    text = slice_text("select a, count() where z = 0 group by a order by count() limit 3", "t", s)
    assert text == "select a, count() from t where (z = 0) and ((((a = 1) or (a = 2)) and (b.c = 'x\\'y')) and (d > 1.0)) group by a order by count() asc limit 3"
    assert parse(slice_text("select a", "t", Slice())).where is None
    with pytest.raises(ValueError, match="FROM"):
        slice_text("select a from t", "t", s)


def test_order_is_replaced():
    assert render(with_order("select a from t order by a limit 5, 2", [("b", False), ("add(a, 1)", True)])) == "select a from t order by b desc, add(a, 1) asc limit 5, 2"
    assert render(with_order("select a from t order by a limit 5", [])) == "select a from t"


def test_background_statement(spark):
    e = Engine(spark)
    e.catalog.register("t", spark.range(10))
    run = e.submit("select sum(id) from t group by div(id, 100)")
    assert run.result(60)[0][0] == 45 and run.percent() == 100
    assert run.statistics().jobs >= 1 and run.statistics().failed_tasks == 0


def test_pages(spark):
    e = Engine(spark)
    e.catalog.register("t", spark.range(25))
    assert [len(p) for p in e.pages("select id from t order by id", 10)] == [10, 10, 5]


def test_partial_results_of_a_flattened_table(spark):
    e, found = Engine(spark), []
    for k in range(3):
        e.catalog.add("t", spark.createDataFrame([([k, 1],)], "r array<long>"))
    run = e.submit("select r, count() from flatten(t, r[*]) group by r order by r", on_update=lambda rows, share: found.append((share, [tuple(r) for r in rows])))
    assert [tuple(r) for r in run.result(60)] == [(0, 1), (1, 4), (2, 1)]
    assert found == [(1 / 3, [(0, 1), (1, 1)]), (2 / 3, [(0, 1), (1, 3)])]


def test_time_limit_and_cancel(spark):
    e = Engine(spark)
    e.catalog.register("t", spark.range(0, 4_000_000_000, 1, 4))
    text = "select count() from t group by div(mul(id, id), add(id, 1))"
    with pytest.raises(TimeoutError):
        e.submit(text, timeout=1).result(60)
    run = e.submit(text)
    run.cancel()
    with pytest.raises(InterruptedError):
        run.result(60)
