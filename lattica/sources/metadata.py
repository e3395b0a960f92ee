"""What a table holds, and whether files fit together in one table."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import types as T

from lattica.errors import LoadError
from lattica.sources.schema import CONTAINER, Field, fields, normal_type


def table_fields(schema: T.StructType) -> list[Field]:
    return fields(schema)


def merge_schemas(schemas: Iterable[T.StructType]) -> T.StructType:
    """The union of the fields of several files; a field must have one type and be repeated everywhere or nowhere."""
    merged: dict[str, Field] = {}
    out = T.StructType([])
    for schema in schemas:
        for f in fields(schema):
            seen = merged.setdefault(f.name, f)
            if (seen.type, seen.repeated) != (f.type, f.repeated):
                raise LoadError(f"{f.name} is {_name(seen)} in one file and {_name(f)} in another")
        out = _union(out, normal_type(schema))
    return out


def _name(f: Field) -> str:
    return ("repeated " if f.repeated else "") + (f.type if f.type != CONTAINER else "container")


def _union(a: T.DataType, b: T.DataType) -> T.DataType:
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(_union(a.elementType, b.elementType))
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        mine = {f.name: f.dataType for f in a.fields}
        other = {f.name: f.dataType for f in b.fields}
        return T.StructType([T.StructField(n, _union(mine[n], other[n]) if n in mine and n in other else mine.get(n, other.get(n))) for n in {**mine, **other}])
    return a
