"""Aggregates by name, constant parameters and input type, in two forms: over rows and over the elements of an array.

Row groups are never empty. Over an array without elements, sum and any give 0, min and max their identity,
concatgroup an empty string, quantile and qvc -1; avg, var, sd and rsd raise an error.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from lattica.functions.scalar import divide
from lattica.plans.tree import DOUBLE, LONG, STRING

LONG_MAX, LONG_MIN, DOUBLE_MAX, DOUBLE_TINY = 2**63 - 1, -(2**63), 1.7976931348623157e308, 4.9e-324


@dataclass(frozen=True)
class Aggregate:
    #: Types of the constant parameters, which come first.
    constants: tuple[str, ...]
    #: Type of the input, None if there is none.
    input: str | None
    result: str
    #: (constants, input, exact) to the aggregate over rows, and over an array; None where there is no such form.
    rows: Callable[[list, Column | None, bool], Column]
    array: Callable[[list, Column, bool], Column] | None
    #: Over rows unless exact: (constants, quantile to its value of the group) to the result.
    discrete: Callable[[list, Callable[[float], Column]], Column] | None = None


def _empty(array: Column, name: str) -> Column:
    return F.when(F.size(array) == 0, F.raise_error(F.lit(f"{name} over an array without elements")).cast("double"))


def _array_sum(a: Column, kind: str) -> Column:
    return F.aggregate(a, F.lit(0 if kind == LONG else 0.0).cast("bigint" if kind == LONG else "double"), lambda s, x: s + x)


def _array_avg(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double")) / F.size(a)


def _array_var(a: Column) -> Column:
    """Population variance in one pass over the elements (count, mean, sum of squares of differences)."""
    zero = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("m"), F.lit(0.0).alias("s"))

    def step(acc: Column, x: Column) -> Column:
        n, d = acc["n"] + 1.0, x.cast("double") - acc["m"]
        m = acc["m"] + d / n
        return F.struct(n.alias("n"), m.alias("m"), (acc["s"] + d * (x.cast("double") - m)).alias("s"))

    return F.aggregate(a, zero, step, lambda acc: acc["s"] / acc["n"])


def _array_quantile(a: Column, q: float) -> Column:
    """Linear interpolation between the sorted elements; -1 without elements."""
    s = F.array_sort(a)
    place = F.lit(float(q)) * (F.size(a) - 1)
    low = F.floor(place).cast("int")
    below, above = F.get(s, low).cast("double"), F.get(s, F.least(low + 1, F.size(a) - 1)).cast("double")
    return F.when(F.size(a) == 0, F.lit(-1.0)).otherwise(below + (above - below) * (place - low))


def _row_quantile(x: Column, q: float) -> Column:
    """With interpolation; the state grows with the distinct values of a group."""
    found = F.percentile(x, F.lit(float(q)))
    return F.when(F.isnan(found), F.lit(-1.0)).otherwise(found)


def _spread(low: Column, high: Column) -> Column:
    return F.when(high + low == 0.0, F.lit(-1.0)).otherwise((high - low) / (high + low))


def _any_rows(c: list, x: Column, exact: bool) -> Column:
    return F.max(F.when(x == F.lit(c[0]), F.lit(1).cast("bigint")).otherwise(F.lit(0).cast("bigint")))


def _numeric(t: str) -> dict[str, Aggregate]:
    limit = (LONG_MAX, LONG_MIN) if t == LONG else (DOUBLE_MAX, DOUBLE_TINY)
    spark = "bigint" if t == LONG else "double"
    return {
        "sum": Aggregate((), t, t, lambda c, x, e: F.sum(x), lambda c, a, e: _array_sum(a, t)),
        "avg": Aggregate((), t, DOUBLE, lambda c, x, e: F.avg(x), lambda c, a, e: _empty(a, "avg").otherwise(_array_avg(a))),
        "min": Aggregate((), t, t, lambda c, x, e: F.min(x), lambda c, a, e: F.coalesce(F.array_min(a), F.lit(limit[0]).cast(spark))),
        "max": Aggregate((), t, t, lambda c, x, e: F.max(x), lambda c, a, e: F.coalesce(F.array_max(a), F.lit(limit[1]).cast(spark))),
        "var": Aggregate((), t, DOUBLE, lambda c, x, e: F.var_pop(x), lambda c, a, e: _empty(a, "var").otherwise(_array_var(a))),
        "sd": Aggregate((), t, DOUBLE, lambda c, x, e: F.stddev_pop(x), lambda c, a, e: _empty(a, "sd").otherwise(F.sqrt(_array_var(a)))),
        "rsd": Aggregate((), t, DOUBLE, lambda c, x, e: divide(F.stddev_pop(x), F.avg(x)), lambda c, a, e: _empty(a, "rsd").otherwise(divide(F.sqrt(_array_var(a)), _array_avg(a)))),
        "quantile": Aggregate((DOUBLE,), t, DOUBLE, lambda c, x, e: _row_quantile(x, c[0]), lambda c, a, e: _array_quantile(a, c[0]), lambda c, at: at(c[0])),
        "qvc": Aggregate((), t, DOUBLE, lambda c, x, e: _spread(_row_quantile(x, 0.25), _row_quantile(x, 0.75)), lambda c, a, e: F.when(F.size(a) == 0, F.lit(-1.0)).otherwise(_spread(_array_quantile(a, 0.25), _array_quantile(a, 0.75))), lambda c, at: _spread(at(0.25), at(0.75))),
    }


def _any(t: str) -> Aggregate:
    return Aggregate((t,), t, LONG, _any_rows, lambda c, a, e: F.exists(a, lambda x: x == F.lit(c[0])).cast("bigint"))


def _concat_rows(delimiter: str):
    return lambda c, x, e: F.array_join(F.sort_array(F.collect_list(x)), c[0] if c else delimiter)


AGGREGATES: dict[str, list[Aggregate]] = {
    "count": [Aggregate((), None, LONG, lambda c, x, e: F.count(F.lit(1)), None)],
    "any": [_any(LONG), _any(DOUBLE), _any(STRING)],
    "concatgroup": [
        Aggregate((), STRING, STRING, _concat_rows(","), lambda c, a, e: F.array_join(a, ",")),
        Aggregate((STRING,), STRING, STRING, _concat_rows(","), lambda c, a, e: F.array_join(a, c[0])),
    ],
}
for _t in (LONG, DOUBLE):
    for _name, _a in _numeric(_t).items():
        AGGREGATES.setdefault(_name, []).append(_a)
