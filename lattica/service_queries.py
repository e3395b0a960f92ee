"""Queries over what is not a statement alone: files written and read, descriptors, metadata, rules, and control.

Each comes with the SQL that gives the same rows. Files go to the folder that all executors share.
"""

from __future__ import annotations

import contextlib
import io
import json
import tempfile
import time
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica import cli
from lattica.engine import Engine
from lattica.errors import AccessError, LoadError, ParseError, ValidationError
from lattica.operators.slices import Slice, slice_text, with_order
from lattica.plans.parser import parse
from lattica.plans.tree import Select, render
from lattica.sources import ingest
from lattica.sources.deploy import Deployment

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir, or in a temporary folder where that is unset and Spark is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="lattica-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _run(engine: Engine, statement: str, names: str) -> DataFrame:
    return engine.plan(statement).toDF(*names.split())


def _array_file(df: DataFrame, path: str) -> str:
    """A small table as one JSON file that holds an array."""
    df.select(F.to_json(F.struct("*")).alias("j")).coalesce(1).agg(F.concat(F.lit("["), F.array_join(F.collect_list("j"), ",\n"), F.lit("]")).alias("value")).write.text(path)
    return path


@_query("SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS n, CAST(n_regionkey AS BIGINT) AS r FROM nation WHERE n_regionkey > 1")
def load_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "csv")
    _read(spark, sf_dir, "nation").write.option("header", True).csv(path)
    engine = Engine(spark)
    engine.catalog.load("t", "csv", path, {"n_nationkey": "long", "n_regionkey": "LONG"})
    return _run(engine, "select n_nationkey, n_name, n_regionkey from t where n_regionkey > 1", "k n r")


@_query("SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN -1 ELSE c_nationkey END::BIGINT AS n, CASE WHEN c_custkey % 3 = 0 THEN 0.0 ELSE c_acctbal END AS a, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_mktsegment END AS s FROM customer")
def load_csv_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Empty cells count as the default of their type."""
    path, gap = scratch(spark, "csv"), lambda c, m: F.when(F.col("c_custkey") % m != 0, F.col(c)).alias(c)
    _read(spark, sf_dir, "customer").select("c_custkey", gap("c_nationkey", 2), gap("c_acctbal", 3), gap("c_mktsegment", 5)).write.option("header", True).csv(path)
    engine = Engine(spark)
    engine.catalog.load("t", "csv", path, {"c_custkey": "long", "c_nationkey": "long", "c_acctbal": "double"})
    return _run(engine, "select c_custkey, c_nationkey, c_acctbal, c_mktsegment from t", "k n a s")


@_query("SELECT l_orderkey AS k, CAST(l_linenumber AS BIGINT) AS n, l_quantity AS q, l_returnflag AS f FROM lineitem WHERE l_quantity > 30")
def load_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An object a line: every line is a row."""
    path = scratch(spark, "json")
    _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag").write.json(path)
    engine = Engine(spark)
    engine.catalog.load("t", "json", path)
    return _run(engine, "select l_orderkey, l_linenumber, l_quantity, l_returnflag from t where l_quantity > 30.", "k n q f")


@_query("SELECT CAST(n_regionkey AS BIGINT) AS r, count(*) AS n, CAST(sum(n_nationkey) AS BIGINT) AS s FROM nation GROUP BY 1")
def load_json_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file that holds an array of objects with an array in each."""
    nested = _read(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.collect_list(F.struct("n_nationkey", "n_name")).alias("nations"))
    engine = Engine(spark)
    engine.catalog.load("t", "json", _array_file(nested, scratch(spark, "array")))
    return _run(engine, "select n_regionkey, nations[length], sum(nations[*].n_nationkey) from t", "r n s")


@_query("SELECT o_orderstatus AS s, count(*) AS n, max(o_orderkey) AS k FROM orders GROUP BY 1")
def write_and_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written in value types, in files of bounded size, and loaded again."""
    path = scratch(spark, "written")
    ingest.write(_read(spark, sf_dir, "orders"), path, comment="orders", file_mb=0.25)
    engine = Engine(spark)
    engine.catalog.load("t", "parquet", path)
    return _run(engine, "select o_orderstatus, count(), max(o_orderkey) from t group by o_orderstatus", "s n k")


@_query("SELECT l_orderkey AS k, l_quantity AS q FROM lineitem WHERE l_quantity >= 40 AND l_returnflag = 'R'")
def two_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of two loads whose fields have different widths."""
    lines = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    paths = [scratch(spark, "part") for _ in range(2)]
    lines.where("l_linenumber <= 2").write.parquet(paths[0])
    lines.where("l_linenumber > 2").withColumn("l_linenumber", F.col("l_linenumber").cast("long")).write.parquet(paths[1])
    engine = Engine(spark)
    for p in paths:
        engine.catalog.load("t", "parquet", p)
    return _run(engine, "select l_orderkey, l_quantity from t where l_quantity >= 40. and l_returnflag = 'R'", "k q")


@_query("SELECT c_custkey AS k, CASE WHEN c_nationkey < 10 THEN c_acctbal ELSE 0.0 END AS a, CASE WHEN c_nationkey < 10 THEN '' ELSE c_mktsegment END AS s, CASE WHEN c_nationkey < 10 THEN -1 ELSE c_nationkey END::BIGINT AS n, 0::BIGINT AS l FROM customer")
def missing_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field that a load does not have counts as the default of its type; an array as one without elements."""
    customers = _read(spark, sf_dir, "customer")
    engine = Engine(spark)
    engine.catalog.add("t", customers.where("c_nationkey < 10").select("c_custkey", "c_acctbal"))
    engine.catalog.add("t", customers.where("c_nationkey >= 10").select("c_custkey", "c_mktsegment", "c_nationkey", F.array().cast("array<struct<x:bigint>>").alias("e")))
    return _run(engine, "select c_custkey, c_acctbal, c_mktsegment, c_nationkey, e[length] from t", "k a s n l")


@_query("SELECT l_orderkey AS o, CAST(l_linenumber AS BIGINT) AS n, CASE WHEN l_orderkey % 2 = 0 THEN l_quantity ELSE 0.0 END AS q, CASE WHEN l_orderkey % 2 = 0 THEN '' ELSE l_returnflag END AS f FROM lineitem")
def flatten_missing_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of two loads with different fields, flattened."""
    lines = _read(spark, sf_dir, "lineitem")
    nest = lambda rest, c: lines.where(F.col("l_orderkey") % 2 == rest).groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", c)).alias("items"))
    engine = Engine(spark)
    engine.catalog.add("t", nest(0, "l_quantity"))
    engine.catalog.add("t", nest(1, "l_returnflag"))
    return _run(engine, "select l_orderkey, items.l_linenumber, items.l_quantity, items.l_returnflag from flatten(t, items[*])", "o n q f")


@_query("SELECT l_returnflag AS f, count(*) AS n FROM lineitem GROUP BY 1")
def flatten_prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flattened table that is kept for later statements."""
    nested = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "l_returnflag")).alias("items"))
    engine = Engine(spark)
    engine.catalog.register("t", nested)
    engine.prepare_flatten("t", "items[*]")
    return _run(engine, "select items.l_returnflag, count() from flatten(t, items[*]) group by items.l_returnflag", "f n")


@_query("SELECT o_orderkey AS o, CAST(l_linenumber AS BIGINT) AS n, l_quantity AS q FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey WHERE c_nationkey < 5")
def flatten_two_level_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two levels of files, of which only the named fields are read."""
    items = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").alias("qty"), "l_returnflag")).alias("items"))
    orders = _read(spark, sf_dir, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"))
    nested = orders.groupBy("o_custkey").agg(F.collect_list(F.struct("o_orderkey", "o_totalprice", "items")).alias("orders"))
    path = scratch(spark, "nested")
    _read(spark, sf_dir, "customer").join(nested, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "c_nationkey", "orders").write.parquet(path)
    engine = Engine(spark)
    engine.catalog.load("t", "parquet", path)
    return _run(engine, "select orders.o_orderkey, orders.items.l_linenumber, orders.items.qty from flatten(t, orders[*].items[*]) where c_nationkey < 5", "o n q")


def _deployed(spark: SparkSession, sf_dir: str, more: str = "") -> tuple[Engine, Deployment, Path]:
    """Regions with their nations, loaded by a descriptor; the descriptors' folder is the driver's."""
    nested = _read(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.collect_list(F.struct("n_nationkey", "n_name")).alias("nations"))
    path = scratch(spark, "deployed")
    ingest.write(nested, path)
    folder = Path(tempfile.mkdtemp(prefix="lattica-control-"))
    (folder / "regions.control").write_text(f"# regions\nfile={path}\ntype=parquet\ntable=regions\nfirstRowId=0\n{more}")
    engine = Engine(spark)
    return engine, Deployment(engine.catalog, str(folder)), folder


@_query("SELECT CAST(n_regionkey AS BIGINT) AS r, CAST(n_nationkey AS BIGINT) AS k, n_name AS n FROM nation")
def deploy_auto_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine, deployment, _ = _deployed(spark, sf_dir, "autoFlatten=nations[*]\n")
    deployment.scan()
    return _run(engine, "select n_regionkey, nations.n_nationkey, nations.n_name from flatten(regions, nations[*])", "r k n")


@_query("SELECT * FROM (VALUES ('loaded', 'regions', true, false), ('broken', 'regions', false, true), ('mended', 'nations,regions', true, false), ('removed', 'nations', true, false)) AS t(step, tables, ready, failure)")
def deploy_watch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptors that come, fail, are mended and go, while the folder is watched."""
    engine, deployment, folder = _deployed(spark, sf_dir)
    rows, path = [], scratch(spark, "nations")

    def until(step: str, done: Callable[[], bool], name: str) -> None:
        deadline = time.time() + 60
        while not done() and time.time() < deadline:
            time.sleep(0.05)
        rows.append((step, ",".join(engine.catalog.tables()), (folder / f"{name}.ready").exists(), (folder / f"{name}.failure").exists()))

    deployment.watch(0.1)
    try:
        until("loaded", lambda: (folder / "regions.ready").exists(), "regions")
        (folder / "nations.control").write_text(f"file={path}\ntype=parquet\ntable=nations\n")
        until("broken", lambda: (folder / "nations.failure").exists() and (folder / "nations.failure").read_text() != "", "nations")
        _read(spark, sf_dir, "nation").write.parquet(path)
        (folder / "nations.control").write_text(f"# now it is there\nfile={path}\ntype=parquet\ntable=nations\n")
        until("mended", lambda: (folder / "nations.ready").exists(), "nations")
        (folder / "regions.control").unlink()
        until("removed", lambda: engine.catalog.tables() == ["nations"], "nations")
    finally:
        deployment.stop()
    return spark.createDataFrame(rows, "step string, tables string, ready boolean, failure boolean")


@_query("SELECT s_suppkey AS k, s_name AS n, 0.0::DOUBLE AS a FROM supplier UNION ALL SELECT c_custkey, '', c_acctbal FROM customer")
def cli_transpose_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commands transpose (JSON and CSV) and merge."""
    a, b, out = scratch(spark, "a"), scratch(spark, "b"), [scratch(spark, "out") for _ in range(3)]
    _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("n")).write.json(a)
    _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("a")).write.option("header", True).csv(b)
    cli.main(["transpose", "-i", a, "-o", out[0], "-t", "json", "-c", "suppliers"], spark)
    cli.main(["transpose", "-i", b, "-o", out[1], "-t", "csv", "--column-type", "k=LONG", "--column-type", "a=DOUBLE"], spark)
    cli.main(["merge", "-i", out[0], out[1], "-o", out[2]], spark)
    engine = Engine(spark)
    engine.catalog.load("t", "parquet", out[2])
    return _run(engine, "select k, n, a from t", "k n a")


@_query("SELECT count(*) AS rows, 'the regions' AS comment, 'r_regionkey LONG, r_name STRING' AS fields FROM region")
def cli_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, said = scratch(spark, "info"), io.StringIO()
    ingest.write(_read(spark, sf_dir, "region"), path, comment="the regions")
    with contextlib.redirect_stdout(said):
        cli.main(["info", path], spark)
    found = json.loads(said.getvalue())
    return spark.createDataFrame([(found["rows"], found["comment"], ", ".join(f"{name} {kind}" for name, kind, _ in found["fields"]))], "rows long, comment string, fields string")


@_query("SELECT * FROM (VALUES ('query', true), ('version', true)) AS t(command, answered)")
def cli_query_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = [io.StringIO(), io.StringIO()]
    with contextlib.redirect_stdout(said[0]):
        cli.main(["query", "select r_name from region where r_regionkey = 0", "--table", f"region={sf_dir}/region.parquet"], spark)
    with contextlib.redirect_stdout(said[1]):
        cli.main(["version"], spark)
    first = _read(spark, sf_dir, "region").where("r_regionkey = 0").first()["r_name"]
    return spark.createDataFrame([("query", first in said[0].getvalue()), ("version", said[1].getvalue().strip() == cli.VERSION)], "command string, answered boolean")


@_query("SELECT CAST(r_regionkey AS BIGINT) AS k, count(n_nationkey) AS n, string_agg(n_name, ',' ORDER BY n_name) AS names FROM region LEFT JOIN nation ON r_regionkey = n_regionkey GROUP BY 1")
def row_builder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of nested objects built one value at a time."""
    nations, rows = _read(spark, sf_dir, "nation").orderBy("n_name").collect(), []
    for r in _read(spark, sf_dir, "region").collect():
        own = [ingest.RowBuilder().with_data("name", n["n_name"]) for n in nations if n["n_regionkey"] == r["r_regionkey"]]
        rows.append(ingest.RowBuilder().with_data("key", r["r_regionkey"]).add_repeated("nations", *own).build())
    engine = Engine(spark)
    engine.catalog.register("t", spark.createDataFrame(rows, "key long, nations array<struct<name:string>>"))
    return _run(engine, "select key, nations[length], concatgroup(nations[*].name) from t", "k n names")


@_query("SELECT * FROM (VALUES ('embeddings', 'embedding', 'DOUBLE', true), ('embeddings', 'vec_id', 'LONG', false), ('nation', 'n_name', 'STRING', false), ('nation', 'n_nationkey', 'LONG', false), ('nation', 'n_regionkey', 'LONG', false), ('region', 'r_name', 'STRING', false), ('region', 'r_regionkey', 'LONG', false)) AS t(table_name, field, type, repeated)")
def table_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list of tables and their fields."""
    engine = Engine(spark)
    for name in ("region", "nation"):
        engine.catalog.register(name, _read(spark, sf_dir, name))
    engine.catalog.register("embeddings", _read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    rows = [(name, f.name, f.type, f.repeated) for name in engine.catalog.tables() for f in engine.catalog.fields(name)]
    return spark.createDataFrame(rows, "table_name string, field string, type string, repeated boolean")


@_query("SELECT l_returnflag AS f, count(*) AS n FROM lineitem WHERE (l_linestatus = 'F' OR l_linestatus = 'O') AND l_quantity > 10 GROUP BY 1 ORDER BY n DESC, f LIMIT 2")
def slice_and_order_as_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statement restricted to a slice, and then put into another order, each handed on as text."""
    engine = Engine(spark)
    engine.catalog.register("lineitem", _read(spark, sf_dir, "lineitem"))
    text = slice_text("select l_returnflag, count() group by l_returnflag order by l_returnflag limit 2", "lineitem", Slice((("l_linestatus", ("F", "O")),), "l_quantity > 10."))
    return _run(engine, render(with_order(text, [("count()", False), ("l_returnflag", True)])), "f n")


@_query("SELECT l_linenumber::BIGINT AS n, quantile_disc(l_suppkey, 0.5) AS m FROM lineitem GROUP BY 1")
def quantile_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles in their default form: the values of the rank itself."""
    engine = Engine(spark)
    engine.catalog.register("lineitem", _read(spark, sf_dir, "lineitem"))
    return _run(engine, "select l_linenumber, long(string(round(quantile(0.5, l_suppkey)))) from lineitem group by l_linenumber", "n m")


@_query("SELECT o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1")
def background_statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statement that runs in the background; its rows are fetched at the end."""
    engine = Engine(spark)
    engine.catalog.register("orders", _read(spark, sf_dir, "orders"))
    rows = engine.submit("select o_orderstatus, count() from orders group by o_orderstatus").result(600)
    return spark.createDataFrame([tuple(r) for r in rows], "s string, n long")


@_query("SELECT o_orderstatus AS s, max(o_orderkey) AS k FROM orders GROUP BY 1")
def result_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A background statement whose rows are written where they were asked for."""
    engine, path = Engine(spark), scratch(spark, "result")
    engine.catalog.register("orders", _read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"))
    engine.submit("select id(o_orderstatus), max(o_orderkey) from orders group by o_orderstatus", path=path).result(600)
    return spark.read.parquet(path).toDF("s", "k")


@_query("SELECT 0 AS step, count(*) FILTER (o_orderkey % 3 = 0) AS n FROM orders UNION ALL SELECT 1, count(*) FILTER (o_orderkey % 3 <> 2) FROM orders UNION ALL SELECT 2, count(*) FROM orders")
def partial_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partial results over the first part of a table of three, the first two, and the whole."""
    engine, found = Engine(spark), []
    for k in range(3):
        engine.catalog.add("t", _read(spark, sf_dir, "orders").where(F.col("o_orderkey") % 3 == k).select("o_orderkey", F.lit("x").alias("x")))
    run = engine.submit("select count() from t group by x", on_update=lambda rows, share: found.append(rows[0][0]))
    rows = run.result(600)
    return spark.createDataFrame([(i, n) for i, n in enumerate([*found, rows[0][0]])], "step int, n long")


@_query("SELECT c_custkey AS k, (row_number() OVER (ORDER BY c_custkey) - 1) // 100 AS page FROM customer")
def paged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark)
    engine.catalog.register("customer", _read(spark, sf_dir, "customer"))
    found = [(r[0], k) for k, page in enumerate(engine.pages("select c_custkey from customer order by c_custkey", 100)) for r in page]
    return spark.createDataFrame(found, "k long, page long")


@_query("SELECT * FROM (VALUES ('cancelled', 'InterruptedError'), ('too long', 'TimeoutError')) AS t(what, error)")
def stopped_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine, rows = Engine(spark), []
    engine.catalog.register("t", spark.range(0, 4_000_000_000, 1, 4))
    text = "select count() from t group by div(mul(id, id), add(id, 1))"
    for what, run in (("cancelled", engine.submit(text)), ("too long", engine.submit(text, timeout=1))):
        if what == "cancelled":
            run.cancel()
        try:
            run.result(120)
            rows.append((what, ""))
        except (InterruptedError, TimeoutError) as e:
            rows.append((what, type(e).__name__))
    return spark.createDataFrame(rows, "what string, error string")


@_query("SELECT * FROM (VALUES ('jobs', true), ('stages', true), ('tasks', true), ('all done', true), ('seconds', true), ('percent', true)) AS t(what, found)")
def statement_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark)
    engine.catalog.register("orders", _read(spark, sf_dir, "orders"))
    run = engine.submit("select o_orderstatus, count() from orders group by o_orderstatus order by count() desc")
    run.result(600)
    s = run.statistics()
    rows = [("jobs", s.jobs > 0), ("stages", s.stages > 0 and len(s.by_stage) == s.stages), ("tasks", s.tasks >= s.stages), ("all done", s.failed_tasks == 0), ("seconds", s.seconds > 0), ("percent", run.percent() == 100)]
    return spark.createDataFrame(rows, "what string, found boolean")


@_query("SELECT * FROM (VALUES ('nation', true), ('region', false)) AS t(table_name, allowed)")
def table_permission(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine, rows = Engine(spark, may_read=lambda name: name != "region"), []
    for name, column in (("nation", "n_name"), ("region", "r_name")):
        engine.catalog.register(name, _read(spark, sf_dir, name))
        try:
            engine.plan(f"select {column} from {name}")
            rows.append((name, True))
        except AccessError:
            rows.append((name, False))
    return spark.createDataFrame(rows, "table_name string, allowed boolean")


#: Statements by rule; those that begin with "ok" are taken, all others rejected. t: k LONG, x DOUBLE, s STRING, r LONG[], e {n LONG, v LONG[]}[].
RULES: dict[str, dict[str, str]] = {
    "rules_select": {
        "from is missing": "select k", "literal": "select 1 from t", "array": "select r[*] from t", "array of a function": "select add(r[*], 1) from t", "unknown table": "select k from u", "unknown column": "select q from t",
        "other case": "select K from t", "field of a value": "select k.x from t", "index of a value": "select k[0] from t", "repeated without index": "select r from t", "container": "select e[0] from t", "ok": "select id(1), r[0], e[0].v[length] from t",
    },
    "rules_where": {"aggregate of rows": "select k from t where count() = 1", "array": "select k from t where r[*] = 1", "literals": "select k from t where 1 = 1", "ok": "select k from t where sum(r[*]) = 1 and k = r[0]"},
    "rules_group": {
        "aggregate": "select k from t group by sum(k)", "literal": "select k from t group by 1", "constant": "select k from t group by id(1)", "array": "select count() from t group by r[*]", "aggregate without group": "select sum(k) from t",
        "order by an aggregate without group": "select k from t order by count()", "aggregate of an aggregate": "select k, sum(sum(k)) from t group by k", "ok": "select k, max(sum(r[*])) from t group by k",
    },
    "rules_having": {"group key": "select k from t group by k having k = 1", "array": "select k from t group by k having r[*] = 1", "ok": "select k from t group by k having add(count(), 1) = 2"},
    "rules_order": {"literal": "select k from t order by 1", "constant": "select k from t order by id(1)", "array": "select k from t order by r[*]", "limit 0": "select k from t order by k limit 0", "negative start": "select k from t order by k limit 1, -1", "ok": "select k from t order by k desc, x limit 2, 0"},
    "rules_types": {
        "long and double": "select x from t where x = 1", "double and long": "select x from t where k = 1.", "function result": "select x from t where log(x) = 1", "string of long": "select concat(k, s) from t", "mixed": "select add(x, 1) from t",
        "too few": "select add(k) from t", "unknown function": "select nothing(k) from t", "aggregate of strings": "select min(s) from t group by s", "count of a column": "select count(k) from t group by k", "quantile of nothing": "select quantile(k) from t group by k",
        "quantile over 1": "select quantile(2., k) from t group by k", "ok": "select add(x, 1.), concat(s, string(k)) from t where k = 1 and x = 1.",
    },
    "rules_repeated": {
        "aggregate of rows inside": "select sum(add(r[*], count())) from t group by k", "other path": "select sum(add(r[*], e[*].n)) from t", "aggregate over an aggregate": "select sum(avg(e[*].v[*])) from t", "repeated projection into a row": "select concat(string(r[*]), s) from t",
        "ok": "select sum(add(e[*].v[*], e[*].n)) from t",
    },
    "rules_flatten": {"not repeated": "select k from flatten(t, k[*])", "without star": "select k from flatten(t, r)", "unknown": "select k from flatten(t, q[*])", "index": "select k from flatten(t, r[0])", "ok": "select r, e[length] from flatten(t, r[*])"},
    "rules_text": {"text behind": "select k from t where k = 1 and", "more": "select k from t limit 1", "space before the bracket": "select count () from t group by k", "open string": "select k from t where s = 'x", "ok": "select k /* note */ from t -- to the end"},
}


def _rules(topic: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine, rows = Engine(spark), []
        engine.catalog.register("t", spark.createDataFrame([], "k long, x double, s string, r array<long>, e array<struct<n:long,v:array<long>>>"))
        statements: dict[str, str | Select] = dict(RULES[topic])
        if topic == "rules_having":
            statements["without group"] = parse("select k from t group by k having count() = 1").with_(group=())
        if topic == "rules_select":
            statements["nothing"] = parse("select k from t").with_(values=(), labels=())
        for rule, statement in statements.items():
            try:
                engine.plan(statement)
                rows.append((rule, False))
            except (ValidationError, ParseError):
                rows.append((rule, True))
        return spark.createDataFrame(rows, "rule string, rejected boolean")

    return run


def _rules_sql(topic: str) -> str:
    rules = [*RULES[topic], *{"rules_having": ["without group"], "rules_select": ["nothing"]}.get(topic, [])]
    return "SELECT * FROM (VALUES " + ", ".join(f"('{r}', {'false' if r == 'ok' else 'true'})" for r in rules) + ") AS t(rule, rejected)"


for _topic in RULES:
    QUERIES[_topic], ORACLE_SQL[_topic] = _rules(_topic), _rules_sql(_topic)


@_query("SELECT * FROM (VALUES ('other type', true), ('repeated', true), ('arrays of arrays', true), ('a map', true), ('same', false)) AS t(rule, rejected)")
def rules_loading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that do not fit a table."""
    kinds = {"other type": "k string", "repeated": "k array<long>", "arrays of arrays": "q array<array<long>>", "a map": "m map<string,long>", "same": "k int"}
    rows = []
    for rule, kind in kinds.items():
        engine = Engine(spark)
        engine.catalog.register("t", spark.createDataFrame([], "k long"))
        try:
            engine.catalog.add("t", spark.createDataFrame([], kind))
            rows.append((rule, False))
        except LoadError:
            rows.append((rule, True))
    return spark.createDataFrame(rows, "rule string, rejected boolean")
