"""Scalar functions by name and argument types. All of them are built-in Spark expressions.

They are built with ANSI mode off (see plans/lower.py), so LONG arithmetic wraps; what must fail does so by an
explicit error.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from lattica.plans.tree import DOUBLE, LONG, STRING


@dataclass(frozen=True)
class Scalar:
    args: tuple[str, ...]
    result: str
    build: Callable[..., Column]
    commutes: bool = False


def divide(a: Column, b: Column) -> Column:
    """IEEE division: by zero it gives an infinity or NaN."""
    by_zero = F.when(F.isnan(a) | (a == 0.0), F.lit(float("nan"))).when(a > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    negative_zero = F.atan2(b, F.lit(-1.0)) < 0
    return F.when(b == 0.0, F.when(negative_zero, -by_zero).otherwise(by_zero)).otherwise(a / b)


def log(x: Column) -> Column:
    """Natural logarithm: -infinity of 0, NaN of negative numbers."""
    x = x.cast("double")
    return F.when(x == 0.0, F.lit(float("-inf"))).when(x < 0.0, F.lit(float("nan"))).otherwise(F.ln(x))


def whole_divide(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.raise_error(F.lit("division by zero"))).otherwise(F.call_function("div", a, b))


def round_half_up(x: Column) -> Column:
    """To the next LONG, halves toward positive infinity."""
    return F.floor(x + 0.5).cast("bigint")


def parse_long(x: Column) -> Column:
    number = F.when(x.rlike(r"^[+-]?[0-9]+$"), x.try_cast("bigint"))
    return F.coalesce(number, F.raise_error(F.concat(F.lit("not a LONG: "), x)).cast("bigint"))


def parse_double(x: Column) -> Column:
    return F.coalesce(x.try_cast("double"), F.raise_error(F.concat(F.lit("not a DOUBLE: "), x)).cast("double"))


def host(x: Column) -> Column:
    """Host of a URI; the input where there is none."""
    found = F.try_parse_url(x, F.lit("HOST"))
    return F.when(found != "", found).otherwise(x)


def top_level_domain(x: Column) -> Column:
    """The last two labels of the host; the input where the host has no such end."""
    h = host(x)
    found = F.regexp_extract(h, r"^(?:[^.].*\.)?([^.]+\.[A-Za-z]+)$", 1)
    return F.when(found != "", found).otherwise(x)


def _same(result: str | None, types: tuple[str, ...], count: int, build: Callable[..., Column], commutes: bool = False) -> list[Scalar]:
    return [Scalar((t,) * count, result or t, build, commutes) for t in types]


SCALARS: dict[str, list[Scalar]] = {
    "add": _same(None, (LONG, DOUBLE), 2, lambda a, b: a + b, True),
    "sub": _same(None, (LONG, DOUBLE), 2, lambda a, b: a - b),
    "mul": _same(None, (LONG, DOUBLE), 2, lambda a, b: a * b, True),
    "div": [Scalar((LONG, LONG), LONG, whole_divide), Scalar((DOUBLE, DOUBLE), DOUBLE, divide)],
    "log": _same(DOUBLE, (LONG, DOUBLE), 1, log),
    "round": [Scalar((DOUBLE,), LONG, round_half_up)],
    "id": _same(None, (LONG, DOUBLE, STRING), 1, lambda a: a),
    "concat": [Scalar((STRING, STRING), STRING, F.concat)],
    "string": _same(STRING, (LONG, DOUBLE), 1, lambda a: a.cast("string")),
    "int": [Scalar((STRING,), LONG, parse_long)],
    "long": [Scalar((STRING,), LONG, parse_long)],
    "double": [Scalar((LONG,), DOUBLE, lambda a: a.cast("double")), Scalar((STRING,), DOUBLE, parse_double)],
    "host": [Scalar((STRING,), STRING, host)],
    "topleveldomain": [Scalar((STRING,), STRING, top_level_domain)],
}
