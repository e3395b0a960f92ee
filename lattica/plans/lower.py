"""An analysed statement as one lazy DataFrame plan.

scan -> explode -> filter -> (group, aggregate) -> order -> limit -> having -> select. HAVING filters the finished
list of rows, after LIMIT, unless ``sql_having`` is set. Columns are chosen before the group, so Catalyst prunes what
is not used down to the fields of nested columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from threading import RLock

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators.ranks import Ranks
from lattica.plans.analyzer import AnalysedCondition, Analysed, Node, analyse
from lattica.plans.tree import Select
from lattica.sources.schema import DEFAULT, SPARK_TYPE

_TEST = {"=": lambda a, b: a == b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


#: One thread at a time builds a plan, as the mode below belongs to the session.
_BUILDING = RLock()


@contextmanager
def wrapping(spark: SparkSession) -> Iterator[None]:
    """Plans built inside wrap LONG arithmetic; the mode is fixed when an expression is built."""
    key = "spark.sql.ansi.enabled"
    with _BUILDING:
        before = spark.conf.get(key, None)
        spark.conf.set(key, "false")
        try:
            yield
        finally:
            spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def _compare(op: str, left: Node, right: Node) -> Column:
    """A comparison on scanned rows. A plain column meets a literal without its default, so that Parquet can skip
    row groups: a missing value passes exactly if its default does."""
    if left.raw is not None and right.literal is not None:
        test = _TEST[op](left.raw, F.lit(right.literal.value).cast(SPARK_TYPE[right.type]))
        passes = _TEST[op](DEFAULT[left.type], right.literal.value)
        return (test | left.raw.isNull()) if passes else (left.raw.isNotNull() & test)
    return _TEST[op](left.build({}), right.build({}))


def _condition(c: AnalysedCondition, compare) -> Column:
    if c.op == "not":
        return ~_condition(c.left, compare)
    if c.op in ("and", "or"):
        left, right = _condition(c.left, compare), _condition(c.right, compare)
        return left & right if c.op == "and" else left | right
    return compare(c.op, c.left, c.right)


class _Grouped:
    """Names for what the group puts out: keys, aggregates, and values of one row for anything else."""

    def __init__(self, a: Analysed, exact: bool):
        self.keys = {n.key: f"k{i}" for i, n in enumerate(a.group)}
        self.exact, self.out, self.columns, self.ranks = exact, {}, [], Ranks()

    def _put(self, key: str, column: Column) -> Column:
        if key not in self.out:
            self.out[key] = f"a{len(self.out)}"
            self.columns.append(column.alias(self.out[key]))
        return F.col(self.out[key])

    def _quantile(self, n: Node, q: float) -> Column:
        key = f"rank({q!r},{n.key})"
        return F.col(self.out[key]) if key in self.out else self._put(key, self.ranks.find(n.key, n.build({}), q))

    def value(self, n: Node) -> Column:
        if n.key in self.keys:
            return F.col(self.keys[n.key])
        if n.is_row_aggregate and n.aggregate.discrete and not self.exact:
            return n.aggregate.discrete(list(n.constants), lambda q: self._quantile(n.args[0], q))
        if n.is_row_aggregate:
            return self._put(n.key, n.aggregate.rows(list(n.constants), n.args[0].build({}) if n.args else None, self.exact))
        if n.constant:
            return n.build({})
        if n.row_aggregate:
            return n.scalar.build(*[self.value(x) for x in n.args])
        return self._put(n.key, F.first(n.build({})))


def lower(df: DataFrame, s: Select, exact_quantiles: bool = False, sql_having: bool = False) -> DataFrame:
    """The rows of a statement over the rows of its source."""
    with wrapping(df.sparkSession):
        a = analyse(s, df.schema, exact_quantiles)
        if a.where:
            df = df.where(_condition(a.where, _compare))
        if a.group:
            g = _Grouped(a, exact_quantiles)
            of = g.value
            values, order = [of(n) for n in a.values], [(of(n), up) for n, up in a.order]
            having = _condition(a.having, lambda op, x, y: _TEST[op](of(x), of(y))) if a.having else None
            group = {n.key: n.build({}) for n in a.group}
            keys = [c.alias(g.keys[key]) for key, c in group.items()]
            df = g.ranks.bounded(df, list(group.values()))
            df = df.groupBy(*keys).agg(*g.columns) if g.columns else df.select(*keys).distinct()
        else:
            of, having = (lambda n: n.build({})), None
            values, order = [of(n) for n in a.values], [(of(n), up) for n, up in a.order]
        if having is not None and sql_having:
            df, having = df.where(having), None
        if having is None and not order:
            return df.select(*[c.alias(f"c{i}") for i, c in enumerate(values)]).toDF(*s.labels)
        # one projection below the sort: what is put out, what orders, what HAVING asks
        below = [c.alias(f"c{i}") for i, c in enumerate(values)] + [c.alias(f"o{i}") for i, (c, _) in enumerate(order)]
        below += [having.alias("h")] if having is not None else []
        df = df.select(*below)
        if order:
            df = df.orderBy(*[F.col(f"o{i}").asc() if up else F.col(f"o{i}").desc() for i, (_, up) in enumerate(order)])
            if s.limit is not None:
                df = (df.offset(s.start) if s.start else df).limit(s.limit)
        if having is not None:
            df = df.where(F.col("h"))
        return df.select(*[F.col(f"c{i}") for i in range(len(values))]).toDF(*s.labels)
