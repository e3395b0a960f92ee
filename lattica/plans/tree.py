"""Syntax tree of the SELECT language."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from decimal import Decimal
from typing import Union

LONG, DOUBLE, STRING = "LONG", "DOUBLE", "STRING"
STAR, LENGTH = "*", "length"
#: A step of a path: a field name and its index (a number, STAR, LENGTH or None).
Step = tuple[str, Union[int, str, None]]


@dataclass(frozen=True)
class Literal:
    type: str
    value: int | float | str


@dataclass(frozen=True)
class Path:
    steps: tuple[Step, ...]

    def __str__(self) -> str:
        return ".".join(name if index is None else f"{name}[{index}]" for name, index in self.steps)


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple[Value, ...]


Value = Union[Literal, Path, Call]


@dataclass(frozen=True)
class Compare:
    op: str
    left: Value
    right: Value


@dataclass(frozen=True)
class And:
    left: Condition
    right: Condition


@dataclass(frozen=True)
class Or:
    left: Condition
    right: Condition


@dataclass(frozen=True)
class Not:
    item: Condition


Condition = Union[Compare, And, Or, Not]


@dataclass(frozen=True)
class Source:
    """A table, or the elements of one of its repeated fields."""

    table: str
    flatten: Path | None = None


@dataclass(frozen=True)
class Order:
    value: Value
    ascending: bool = True


@dataclass(frozen=True)
class Select:
    values: tuple[Value, ...]
    labels: tuple[str, ...]
    source: Source | None = None
    where: Condition | None = None
    group: tuple[Value, ...] = ()
    having: Condition | None = None
    order: tuple[Order, ...] = ()
    limit: int | None = None
    start: int = 0

    def with_(self, **changes) -> Select:
        return replace(self, **changes)


def paths(s: Select) -> list[Path]:
    """All paths that a statement reads, those of its source left out."""
    out: list[Path] = []

    def value(v: Value) -> None:
        if isinstance(v, Path):
            out.append(v)
        elif isinstance(v, Call):
            for a in v.args:
                value(a)

    def condition(c: Condition | None) -> None:
        if isinstance(c, Compare):
            value(c.left)
            value(c.right)
        elif isinstance(c, Not):
            condition(c.item)
        elif c is not None:
            condition(c.left)
            condition(c.right)

    for v in (*s.values, *s.group, *(o.value for o in s.order)):
        value(v)
    condition(s.where)
    condition(s.having)
    return out


def quote(value: int | float | str) -> str:
    """A literal as text that parses to it."""
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(value, float):
        if not math.isfinite(value):
            raise ValueError(f"{value} has no literal")
        text = format(Decimal(repr(value)), "f")
        return text if "." in text else text + ".0"
    return str(value)


def render_value(v: Value) -> str:
    if isinstance(v, Literal):
        return quote(v.value)
    if isinstance(v, Path):
        return str(v)
    return f"{v.name}({', '.join(map(render_value, v.args))})"


def render_condition(c: Condition) -> str:
    if isinstance(c, Compare):
        return f"{render_value(c.left)} {c.op} {render_value(c.right)}"
    if isinstance(c, Not):
        return f"not ({render_condition(c.item)})"
    word = "and" if isinstance(c, And) else "or"
    return f"({render_condition(c.left)}) {word} ({render_condition(c.right)})"


def render(s: Select) -> str:
    """The statement as text that parses to the same tree."""
    out = "select " + ", ".join(map(render_value, s.values))
    if s.source:
        out += f" from flatten({s.source.table}, {s.source.flatten})" if s.source.flatten else f" from {s.source.table}"
    if s.where:
        out += f" where {render_condition(s.where)}"
    if s.group:
        out += " group by " + ", ".join(map(render_value, s.group))
    if s.having:
        out += f" having {render_condition(s.having)}"
    if s.order:
        out += " order by " + ", ".join(f"{render_value(o.value)} {'asc' if o.ascending else 'desc'}" for o in s.order)
    if s.limit is not None:
        out += f" limit {s.limit}" + (f", {s.start}" if s.start else "")
    return out
