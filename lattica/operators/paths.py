"""Paths into nested rows, and the mapping over arrays that `[*]` asks for.

An expression that ranges over `[*]` is a builder of the element together with the levels it ranges over. Several
arguments are aligned when the levels of one begin with those of the other; a shorter one gives the parent element's
value. The array itself is nested transforms, flattened, so that its length is the number of combinations.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.errors import ValidationError
from lattica.plans.tree import LENGTH, LONG, STAR, Path
from lattica.sources.schema import field_of, filled, raw, value_type

#: The current element of each level, by its key.
Env = dict[str, Any]


@dataclass(frozen=True)
class Level:
    key: str
    array: Callable[[Env], Column]
    #: The fields of the elements that are read, where elements have fields.
    fields: tuple[tuple[str, T.DataType], ...] = ()


class _Picked:
    """An element of which only some fields are read: the value of the one field, or a struct of several."""

    def __init__(self, element: Column, single: bool):
        self._element, self._single = element, single

    def getField(self, name: str) -> Column:  # noqa: N802 - stands in for a Column
        return self._element if self._single else self._element.getField(name)


def _elements(level: Level, env: Env) -> tuple[Column, Callable[[Column], Column | _Picked]]:
    """The array of a level cut down to the fields that are read, so that a scan reads no others."""
    array = level.array(env)
    if not level.fields:
        return array, lambda x: x
    parts = [array.getField(name) for name, _ in level.fields]
    if len(parts) == 1:
        return parts[0], lambda x: _Picked(x, True)
    kind = T.ArrayType(T.StructType([T.StructField(name, t) for name, t in level.fields]))
    return F.arrays_zip(*parts).cast(kind), lambda x: _Picked(x, False)


@dataclass(frozen=True)
class PathPlan:
    type: str
    levels: tuple[Level, ...]
    build: Callable[[Env], Column]
    #: The field without its default, where the path goes through no array; else None.
    raw: Column | None


def _root(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def resolve(schema: T.StructType, path: Path) -> PathPlan:
    """Type, levels and builder of a path; raises where the path does not fit the schema."""
    kind: T.DataType = schema
    levels: list[Level] = []
    current: Callable[[Env], Column] | None = None
    through_array, text = False, ""
    for place, (name, index) in enumerate(path.steps):
        text += ("." if text else "") + name
        field = field_of(kind, name, text)
        if place and path.steps[place - 1][1] == STAR:
            levels[-1] = replace(levels[-1], fields=((name, field.dataType),))
        parent, kind = current, field.dataType
        current = (lambda env, p=parent, n=name: p(env).getField(n)) if parent else (lambda env, n=name: _root(n))
        repeated = isinstance(kind, T.ArrayType)
        if (index is None) == repeated:
            raise ValidationError(f"{text} is {'repeated: use an index' if repeated else 'not repeated'}")
        if index is None:
            continue
        array, kind, through_array = current, kind.elementType, True
        if index == LENGTH:
            if place != len(path.steps) - 1:
                raise ValidationError(f"{text}[length] has no fields")
            return PathPlan(LONG, tuple(levels), lambda env: F.greatest(F.coalesce(F.size(array(env)), F.lit(0)), F.lit(0)).cast("bigint"), None)
        text += f"[{index}]"
        if index == STAR:
            key = text
            levels.append(Level(key, array))
            current = lambda env, k=key: env[k]
        else:
            current = lambda env, a=array, i=index: F.get(a(env), F.lit(i))
    if isinstance(kind, T.StructType):
        raise ValidationError(f"{text} has fields and no value of its own")
    leaf, of = current, kind
    plain = None if through_array else raw(leaf({}), of)
    return PathPlan(value_type(kind), tuple(levels), lambda env: filled(leaf(env), of), plain)


def align(all_levels: list[tuple[Level, ...]]) -> tuple[Level, ...]:
    """The longest levels, if all others are a beginning of them; with the fields that any of them reads."""
    longest = max(all_levels, key=len, default=())
    fields: list[dict[str, T.DataType]] = [{} for _ in longest]
    for levels in all_levels:
        if [x.key for x in levels] != [x.key for x in longest[: len(levels)]]:
            raise ValidationError(f"{levels[-1].key} and {longest[-1].key} do not repeat along the same path")
        for known, level in zip(fields, levels, strict=False):
            known.update(level.fields)
    return tuple(replace(x, fields=tuple(sorted(f.items()))) for x, f in zip(longest, fields, strict=True))


def to_array(levels: tuple[Level, ...], build: Callable[[Env], Column], spark_type: str) -> Column:
    """The flat array of the element for all combinations; a missing array has no elements."""

    def nested(env: Env, levels: tuple[Level, ...]) -> Column:
        first, rest = levels[0], levels[1:]
        array, element = _elements(first, env)
        if not rest:
            return F.transform(array, lambda x: build(env | {first.key: element(x)}))
        inner = F.transform(array, lambda x: nested(env | {first.key: element(x)}, rest))
        return F.flatten(F.filter(inner, lambda x: x.isNotNull()))

    return F.coalesce(nested({}, levels), F.array().cast(f"array<{spark_type}>"))
