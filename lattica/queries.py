"""Statements over the shared test tables, each with the SQL that gives the same rows.

Every entry is (statement, output names, SQL). Doubles that are sums are rounded on both sides, as their last bits
depend on the order of addition.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica import service_queries
from lattica.engine import Engine
from lattica.operators.slices import Slice

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def orders_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their items as an array; orders without items have an empty one."""
    items = F.struct("l_linenumber", F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("price"), F.col("l_returnflag").alias("flag"))
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(items)).alias("items"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").drop("l_orderkey")


def customers_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with their orders, and those with their items."""
    orders = orders_nested(spark, sf_dir).groupBy("o_custkey").agg(F.collect_list(F.struct("o_orderkey", "o_totalprice", "items")).alias("orders"))
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey")
    return customers.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").drop("o_custkey")


def engine_for(spark: SparkSession, sf_dir: str, **options) -> Engine:
    engine = Engine(spark, **options)
    for name in TABLES:
        engine.catalog.register(name, spark.read.parquet(f"{sf_dir}/{name}.parquet"))
    return engine


#: name: (statement, names, SQL, names of columns that are rounded to four digits)
FLAT: dict[str, tuple[str, str, str, str]] = {
    "scan_project": ("select o_orderkey, o_totalprice from orders", "o_orderkey o_totalprice", "SELECT o_orderkey, o_totalprice FROM orders", ""),
    "filter_eq": ("select l_orderkey, l_linenumber from lineitem where l_returnflag = 'R'", "k n", "SELECT l_orderkey AS k, CAST(l_linenumber AS BIGINT) AS n FROM lineitem WHERE l_returnflag = 'R'", ""),
    "filter_range": ("select l_orderkey, l_quantity from lineitem where l_quantity >= 10. and 20. > l_quantity", "k q", "SELECT l_orderkey AS k, l_quantity AS q FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 20", ""),
    "filter_colcol": ("select l_orderkey, l_partkey from lineitem where l_orderkey > l_partkey", "k p", "SELECT l_orderkey AS k, l_partkey AS p FROM lineitem WHERE l_orderkey > l_partkey", ""),
    "filter_not": ("select l_orderkey from lineitem where not (l_returnflag = 'R' or l_linenumber <= 3)", "k", "SELECT l_orderkey AS k FROM lineitem WHERE NOT (l_returnflag = 'R' OR l_linenumber <= 3)", ""),
    "not_loose": ("select l_orderkey, l_linenumber from lineitem where not l_linenumber = 1 and l_returnflag = 'R'", "k n", "SELECT l_orderkey AS k, CAST(l_linenumber AS BIGINT) AS n FROM lineitem WHERE NOT (l_linenumber = 1 AND l_returnflag = 'R')", ""),
    "filter_expression": ("select l_orderkey from lineitem where add(l_linenumber, 1) = 3 and mul(l_quantity, 2.) < 30.", "k", "SELECT l_orderkey AS k FROM lineitem WHERE l_linenumber + 1 = 3 AND l_quantity * 2 < 30", ""),
    "order_limit": ("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 5", "k p", "SELECT o_orderkey AS k, o_totalprice AS p FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5", ""),
    "order_limit_offset": ("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey asc limit 5, 3", "k p", "SELECT o_orderkey AS k, o_totalprice AS p FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5 OFFSET 3", ""),
    "order_unselected": ("select o_orderkey from orders order by sub(0., o_totalprice), o_orderkey limit 7", "k", "SELECT o_orderkey AS k FROM orders ORDER BY -o_totalprice, o_orderkey LIMIT 7", ""),
    "group_count": ("select l_returnflag, count() from lineitem group by l_returnflag order by count() desc", "flag n", "SELECT l_returnflag AS flag, count(*) AS n FROM lineitem GROUP BY 1", ""),
    "group_multi": ("select l_returnflag, l_linestatus, count(), sum(l_linenumber) from lineitem group by l_returnflag, l_linestatus", "flag status n s", "SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS s FROM lineitem GROUP BY 1, 2", ""),
    "group_expr": ("select div(l_orderkey, 1000), count() from lineitem group by div(l_orderkey, 1000)", "b n", "SELECT l_orderkey // 1000 AS b, count(*) AS n FROM lineitem GROUP BY 1", ""),
    "group_commuted": ("select add(l_linenumber, l_suppkey), count() from lineitem group by add(l_suppkey, l_linenumber)", "s n", "SELECT l_linenumber + l_suppkey AS s, count(*) AS n FROM lineitem GROUP BY 1", ""),
    "group_distinct": ("select l_returnflag, l_linestatus from lineitem group by l_returnflag, l_linestatus", "flag status", "SELECT DISTINCT l_returnflag AS flag, l_linestatus AS status FROM lineitem", ""),
    "group_first": ("select l_returnflag, concat(l_returnflag, 'x'), count() from lineitem group by l_returnflag", "flag x n", "SELECT l_returnflag AS flag, l_returnflag || 'x' AS x, count(*) AS n FROM lineitem GROUP BY 1", ""),
    "agg_sum_avg_min_max": ("select l_returnflag, sum(l_quantity), avg(l_extendedprice), min(l_discount), max(l_tax), avg(l_linenumber), min(l_partkey), max(l_suppkey) from lineitem group by l_returnflag", "flag s a mn mx al mnl mxl", "SELECT l_returnflag AS flag, round(sum(l_quantity), 4) AS s, round(avg(l_extendedprice), 4) AS a, min(l_discount) AS mn, max(l_tax) AS mx, round(avg(l_linenumber), 4) AS al, min(l_partkey) AS mnl, max(l_suppkey) AS mxl FROM lineitem GROUP BY 1", "s a al"),
    "agg_var_sd_rsd": ("select l_linestatus, var(l_quantity), sd(l_linenumber), rsd(l_quantity) from lineitem group by l_linestatus", "status v s r", "SELECT l_linestatus AS status, round(var_pop(l_quantity), 4) AS v, round(stddev_pop(l_linenumber), 4) AS s, round(stddev_pop(l_quantity) / avg(l_quantity), 4) AS r FROM lineitem GROUP BY 1", "v s r"),
    "agg_quantile": ("select l_returnflag, quantile(0.5, l_linenumber), quantile(0.9, l_quantity) from lineitem group by l_returnflag", "flag m q", "SELECT l_returnflag AS flag, round(quantile_cont(CAST(l_linenumber AS DOUBLE), 0.5), 4) AS m, round(quantile_cont(l_quantity, 0.9), 4) AS q FROM lineitem GROUP BY 1", "m q"),
    "agg_qvc": ("select l_returnflag, qvc(l_quantity) from lineitem group by l_returnflag", "flag q", "SELECT l_returnflag AS flag, round((quantile_cont(l_quantity, 0.75) - quantile_cont(l_quantity, 0.25)) / (quantile_cont(l_quantity, 0.75) + quantile_cont(l_quantity, 0.25)), 4) AS q FROM lineitem GROUP BY 1", "q"),
    "agg_any": ("select l_suppkey, any(7, l_linenumber), any('R', l_returnflag), any(50., l_quantity) from lineitem group by l_suppkey", "k a b c", "SELECT l_suppkey AS k, max(CAST(l_linenumber = 7 AS BIGINT)) AS a, max(CAST(l_returnflag = 'R' AS BIGINT)) AS b, max(CAST(l_quantity = 50 AS BIGINT)) AS c FROM lineitem GROUP BY 1", ""),
    "agg_concatgroup": ("select n_regionkey, concatgroup(n_name), concatgroup(' / ', n_name) from nation group by n_regionkey", "k a b", "SELECT CAST(n_regionkey AS BIGINT) AS k, string_agg(n_name, ',' ORDER BY n_name) AS a, string_agg(n_name, ' / ' ORDER BY n_name) AS b FROM nation GROUP BY 1", ""),
    "post_agg_project": ("select l_returnflag, add(count(), 1), round(div(sum(l_quantity), double(count()))) from lineitem group by l_returnflag", "flag n a", "SELECT l_returnflag AS flag, count(*) + 1 AS n, CAST(floor(sum(l_quantity) / count(*) + 0.5) AS BIGINT) AS a FROM lineitem GROUP BY 1", ""),
    "having": ("select l_suppkey, count() from lineitem group by l_suppkey having count() > 600", "k n", "SELECT l_suppkey AS k, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 600", ""),
    "having_and_or": ("select l_suppkey, count() from lineitem group by l_suppkey having count() > 600 and min(l_linenumber) = 1 or not max(l_quantity) = 50.", "k n", "SELECT l_suppkey AS k, count(*) AS n FROM lineitem GROUP BY 1 HAVING (count(*) > 600 AND min(l_linenumber) = 1) OR NOT max(l_quantity) = 50", ""),
    "having_limit": ("select l_suppkey, count() from lineitem group by l_suppkey having count() > 600 order by l_suppkey limit 20", "k n", "SELECT * FROM (SELECT l_suppkey AS k, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY 1 LIMIT 20) WHERE n > 600", ""),
    "fn_arith_long": ("select l_orderkey, l_linenumber, add(l_orderkey, 5), sub(l_partkey, l_suppkey), mul(l_linenumber, l_suppkey), div(l_partkey, 7) from lineitem", "k n a s m d", "SELECT l_orderkey AS k, CAST(l_linenumber AS BIGINT) AS n, l_orderkey + 5 AS a, l_partkey - l_suppkey AS s, l_linenumber * l_suppkey AS m, l_partkey // 7 AS d FROM lineitem", ""),
    "fn_arith_double": ("select o_orderkey, add(o_totalprice, 0.5), sub(o_totalprice, 1.5), mul(o_totalprice, 2.), div(o_totalprice, 4.) from orders", "k a s m d", "SELECT o_orderkey AS k, o_totalprice + 0.5 AS a, o_totalprice - 1.5 AS s, o_totalprice * 2 AS m, o_totalprice / 4 AS d FROM orders", ""),
    "fn_log": ("select o_orderkey, log(o_totalprice), log(add(o_orderkey, 1)) from orders", "k a b", "SELECT o_orderkey AS k, round(ln(o_totalprice), 4) AS a, round(ln(o_orderkey + 1), 4) AS b FROM orders", "a b"),
    "fn_round": ("select c_custkey, round(c_acctbal) from customer", "k r", "SELECT c_custkey AS k, CAST(floor(c_acctbal + 0.5) AS BIGINT) AS r FROM customer", ""),
    "fn_concat": ("select n_nationkey, concat(n_name, concat('-', string(n_regionkey))) from nation", "k c", "SELECT CAST(n_nationkey AS BIGINT) AS k, n_name || '-' || n_regionkey AS c FROM nation", ""),
    "fn_casts": ("select o_orderkey, string(o_orderkey), long(string(o_orderkey)), int('17'), double(o_custkey), double('2.5') from orders", "k s l i d e", "SELECT o_orderkey AS k, CAST(o_orderkey AS VARCHAR) AS s, o_orderkey AS l, CAST(17 AS BIGINT) AS i, CAST(o_custkey AS DOUBLE) AS d, CAST(2.5 AS DOUBLE) AS e FROM orders", ""),
    "fn_id": ("select n_nationkey, id(3), id('x'), id(n_name) from nation", "k a b c", "SELECT CAST(n_nationkey AS BIGINT) AS k, CAST(3 AS BIGINT) AS a, 'x' AS b, n_name AS c FROM nation", ""),
    "fn_host": ("select page_id, host(url) from pages", "k h", "SELECT page_id AS k, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS h FROM pages", ""),
    "fn_tld": ("select page_id, topleveldomain(url) from pages", "k t", "SELECT page_id AS k, regexp_extract(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1), '([^.]+\\.[a-zA-Z]+)$', 1) AS t FROM pages", ""),
    "group_host": ("select topleveldomain(url), count() from pages group by topleveldomain(url)", "t n", "SELECT regexp_extract(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1), '([^.]+\\.[a-zA-Z]+)$', 1) AS t, count(*) AS n FROM pages GROUP BY 1", ""),
    "time_as_long": ("select event_id, div(ts, 1000000) from events where ts > 0", "k s", "SELECT event_id AS k, CAST(epoch_us(ts) // 1000000 AS BIGINT) AS s FROM events", ""),
    "vec_sum": ("select vec_id, sum(embedding[*]), max(embedding[*]), embedding[length], embedding[3] from embeddings", "k s m n x", "SELECT vec_id AS k, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4) AS s, CAST(list_max(embedding) AS DOUBLE) AS m, len(embedding) AS n, CAST(embedding[4] AS DOUBLE) AS x FROM embeddings", "s"),
    "filter_eq_columns": ("select l_orderkey, l_linenumber, l_suppkey from lineitem where l_linenumber = l_suppkey", "k n s", "SELECT l_orderkey AS k, CAST(l_linenumber AS BIGINT) AS n, l_suppkey AS s FROM lineitem WHERE l_linenumber = l_suppkey", ""),
    "agg_var_rsd_long": ("select l_linestatus, var(l_linenumber), rsd(l_linenumber), sd(l_quantity) from lineitem group by l_linestatus", "status v r s", "SELECT l_linestatus AS status, round(var_pop(l_linenumber), 4) AS v, round(stddev_pop(l_linenumber) / avg(l_linenumber), 4) AS r, round(stddev_pop(l_quantity), 4) AS s FROM lineitem GROUP BY 1", "v r s"),
    "agg_qvc_long": ("select l_returnflag, qvc(l_linenumber) from lineitem group by l_returnflag", "flag q", "SELECT l_returnflag AS flag, round((quantile_cont(CAST(l_linenumber AS DOUBLE), 0.75) - quantile_cont(CAST(l_linenumber AS DOUBLE), 0.25)) / (quantile_cont(CAST(l_linenumber AS DOUBLE), 0.75) + quantile_cont(CAST(l_linenumber AS DOUBLE), 0.25)), 4) AS q FROM lineitem GROUP BY 1", "q"),
    "fn_id_double": ("select o_orderkey, id(o_totalprice), id(2.5) from orders", "k p x", "SELECT o_orderkey AS k, o_totalprice AS p, CAST(2.5 AS DOUBLE) AS x FROM orders", ""),
    "fn_string_double": ("select l_orderkey, l_linenumber, string(l_quantity), string(l_discount) from lineitem", "k n q d", "SELECT l_orderkey AS k, CAST(l_linenumber AS BIGINT) AS n, CAST(l_quantity AS VARCHAR) AS q, CAST(l_discount AS VARCHAR) AS d FROM lineitem", ""),
    "fn_parse": ("select o_orderkey, int(string(o_custkey)), double(string(o_custkey)) from orders", "k i d", "SELECT o_orderkey AS k, o_custkey AS i, CAST(o_custkey AS DOUBLE) AS d FROM orders", ""),
    "fn_wrap": ("select o_orderkey, add(9223372036854775807, o_orderkey), mul(o_orderkey, 9223372036854775807) from orders where o_orderkey > 0", "k a m", "SELECT o_orderkey AS k, CAST(-9223372036854775808 AS BIGINT) + (o_orderkey - 1) AS a, CASE WHEN o_orderkey % 2 = 0 THEN -o_orderkey ELSE 9223372036854775807 - (o_orderkey - 1) END AS m FROM orders WHERE o_orderkey > 0", ""),
    "ieee_division": ("select o_orderkey from orders where div(o_totalprice, 0.) > 1000000000. and div(sub(0., o_totalprice), 0.) < -1000000000.", "k", "SELECT o_orderkey AS k FROM orders WHERE o_totalprice > 0", ""),
    "ieee_nan_equal": ("select o_orderkey from orders where div(sub(o_totalprice, o_totalprice), 0.) = log(sub(0., o_totalprice))", "k", "SELECT o_orderkey AS k FROM orders WHERE o_totalprice > 0", ""),
    "ieee_log_zero": ("select o_orderkey from orders where log(sub(o_orderkey, o_orderkey)) < -1000000000.", "k", "SELECT o_orderkey AS k FROM orders", ""),
    "empty_result": ("select o_orderkey, o_totalprice from orders where o_orderkey < 0", "k p", "SELECT o_orderkey AS k, o_totalprice AS p FROM orders WHERE o_orderkey < 0", ""),
    "keyword_case": ("SELECT n_name FROM nation WHERE NOT n_regionkey = 1 ORDER BY n_name LIMIT 4", "n", "SELECT n_name AS n FROM nation WHERE n_regionkey <> 1 ORDER BY 1 LIMIT 4", ""),
    "not_in_both": ("select l_suppkey, count() from lineitem where not l_linenumber > 3 group by l_suppkey having not count() < 300", "k n", "SELECT l_suppkey AS k, count(*) AS n FROM lineitem WHERE NOT l_linenumber > 3 GROUP BY 1 HAVING NOT count(*) < 300", ""),
}

_ITEMS = "FROM orders o LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey"
NESTED: dict[str, tuple[str, str, str, str]] = {
    "nested_len": ("select o_orderkey, items[length] from orders_nested", "k n", f"SELECT o_orderkey AS k, count(l_orderkey) AS n {_ITEMS} GROUP BY 1", ""),
    "nested_index": ("select o_orderkey, items[0].qty, items[0].l_linenumber, items[6].flag from orders_nested", "k q l f", f"SELECT o_orderkey AS k, coalesce(max(l_quantity) FILTER (WHERE r = 1), 0.0) AS q, CAST(coalesce(max(l_linenumber) FILTER (WHERE r = 1), -1) AS BIGINT) AS l, coalesce(max(l_returnflag) FILTER (WHERE r = 7), '') AS f FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_quantity, l_extendedprice, l_returnflag) AS r {_ITEMS}) GROUP BY 1", ""),
    "col_sum": ("select o_orderkey, sum(items[*].qty), sum(items[*].l_linenumber) from orders_nested", "k s n", f"SELECT o_orderkey AS k, round(coalesce(sum(l_quantity), 0.0), 4) AS s, CAST(coalesce(sum(l_linenumber), 0) AS BIGINT) AS n {_ITEMS} GROUP BY 1", "s"),
    "col_avg": ("select o_orderkey, avg(items[*].price), var(items[*].qty), sd(items[*].l_linenumber), rsd(items[*].qty) from orders_nested where items[length] > 0", "k a v s r", f"SELECT o_orderkey AS k, round(avg(l_extendedprice), 6) AS a, round(var_pop(l_quantity), 4) AS v, round(stddev_pop(l_linenumber), 4) AS s, round(stddev_pop(l_quantity) / avg(l_quantity), 6) AS r {_ITEMS} WHERE l_orderkey IS NOT NULL GROUP BY 1", "a:6 v s r:6"),
    "col_minmax": ("select o_orderkey, min(items[*].qty), max(items[*].l_linenumber) from orders_nested where items[length] > 0", "k a b", f"SELECT o_orderkey AS k, min(l_quantity) AS a, CAST(max(l_linenumber) AS BIGINT) AS b {_ITEMS} WHERE l_orderkey IS NOT NULL GROUP BY 1", ""),
    "col_quantile": ("select o_orderkey, quantile(0.5, items[*].qty), qvc(items[*].l_linenumber) from orders_nested", "k m q", f"SELECT o_orderkey AS k, round(coalesce(quantile_cont(l_quantity, 0.5), -1.0), 4) AS m, round(coalesce((quantile_cont(CAST(l_linenumber AS DOUBLE), 0.75) - quantile_cont(CAST(l_linenumber AS DOUBLE), 0.25)) / (quantile_cont(CAST(l_linenumber AS DOUBLE), 0.75) + quantile_cont(CAST(l_linenumber AS DOUBLE), 0.25)), -1.0), 4) AS q {_ITEMS} GROUP BY 1", "m q"),
    "col_any": ("select o_orderkey, any('R', items[*].flag) from orders_nested where any(3, items[*].l_linenumber) = 1", "k a", f"SELECT o_orderkey AS k, max(CAST(l_returnflag = 'R' AS BIGINT)) AS a {_ITEMS} GROUP BY 1 HAVING max(CAST(l_linenumber = 3 AS INTEGER)) = 1", ""),
    "col_concat": ("select o_orderkey, concatgroup('+', items[*].flag) from orders_nested", "k c", f"SELECT o_orderkey AS k, coalesce(string_agg(l_returnflag, '+' ORDER BY l_linenumber, l_quantity, l_extendedprice, l_returnflag), '') AS c {_ITEMS} GROUP BY 1", ""),
    "rep_project": ("select o_orderkey, sum(add(items[*].l_linenumber, 10)) from orders_nested", "k s", f"SELECT o_orderkey AS k, CAST(coalesce(sum(l_linenumber + 10), 0) AS BIGINT) AS s {_ITEMS} GROUP BY 1", ""),
    "rep_project_two_args": ("select o_orderkey, sum(mul(items[*].qty, items[*].price)), max(add(items[*].l_linenumber, o_orderkey)) from orders_nested where items[length] >= 1", "k s m", f"SELECT o_orderkey AS k, round(sum(l_quantity * l_extendedprice), 4) AS s, max(l_linenumber + o_orderkey) AS m {_ITEMS} WHERE l_orderkey IS NOT NULL GROUP BY 1", "s"),
    "row_over_col": ("select o_orderstatus, max(sum(items[*].qty)), sum(items[length]) from orders_nested group by o_orderstatus", "status m n", f"SELECT o_orderstatus AS status, round(max(s), 4) AS m, CAST(sum(n) AS BIGINT) AS n FROM (SELECT o_orderkey, o_orderstatus, coalesce(sum(l_quantity), 0.0) AS s, count(l_orderkey) AS n {_ITEMS} GROUP BY 1, 2) GROUP BY 1", "m"),
    "group_by_col": ("select sum(items[*].l_linenumber), count() from orders_nested group by sum(items[*].l_linenumber) order by count() desc", "s n", f"SELECT s, count(*) AS n FROM (SELECT o_orderkey, CAST(coalesce(sum(l_linenumber), 0) AS BIGINT) AS s {_ITEMS} GROUP BY 1) GROUP BY 1", ""),
    "flatten_group": ("select items.flag, count(), sum(items.qty) from flatten(orders_nested, items[*]) group by items.flag", "flag n s", "SELECT l_returnflag AS flag, count(*) AS n, round(sum(l_quantity), 4) AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1", "s"),
    "flatten_two_level": ("select c_custkey, orders.o_orderkey, orders.items.l_linenumber, orders.items.qty from flatten(customers_nested, orders[*].items[*])", "c o l q", "SELECT c_custkey AS c, o_orderkey AS o, CAST(l_linenumber AS BIGINT) AS l, l_quantity AS q FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey", ""),
    "rep_project_two_level": ("select c_custkey, sum(add(orders[*].items[*].qty, orders[*].o_totalprice)), any(1, orders[*].items[*].l_linenumber) from customers_nested", "c s a", "SELECT c_custkey AS c, round(coalesce(sum(l_quantity + o_totalprice), 0.0), 2) AS s, coalesce(max(CAST(l_linenumber = 1 AS BIGINT)), 0) AS a FROM customer LEFT JOIN orders ON c_custkey = o_custkey LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1", "s:2"),
}


def _finish(df: DataFrame, names: str, rounded: str) -> DataFrame:
    df = df.toDF(*names.split())
    for item in rounded.split():
        name, _, digits = item.partition(":")
        df = df.withColumn(name, F.round(name, int(digits or 4)))
    return df


def _query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = engine_for(spark, sf_dir, exact_quantiles=True)
        if name in NESTED:
            engine.catalog.register("orders_nested", orders_nested(spark, sf_dir))
            engine.catalog.register("customers_nested", customers_nested(spark, sf_dir))
        statement, names, _, rounded = (FLAT | NESTED)[name]
        return _finish(engine.plan(statement), names, rounded)

    return run


def slice_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statement restricted to a slice: values of two fields and a condition."""
    s = Slice((("l_returnflag", ("R", "A")), ("l_linestatus", ("F",))), "l_quantity > 10.")
    df = engine_for(spark, sf_dir).sliced("select l_returnflag, count() where l_linenumber < 4 group by l_returnflag", "lineitem", s)
    return df.toDF("flag", "n")


_SLICE_SQL = "SELECT l_returnflag AS flag, count(*) AS n FROM lineitem WHERE l_linenumber < 4 AND l_returnflag IN ('R', 'A') AND l_linestatus = 'F' AND l_quantity > 10 GROUP BY 1"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {n: _query(n) for n in FLAT | NESTED} | {"slice": slice_query}
ORACLE_SQL: dict[str, str] = {n: e[2] for n, e in (FLAT | NESTED).items()} | {"slice": _SLICE_SQL}
QUERIES |= service_queries.QUERIES
ORACLE_SQL |= service_queries.ORACLE_SQL
