"""flatten(table, field[*]): one row per element, all other columns repeated; rows without elements disappear."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.errors import ValidationError
from lattica.plans.tree import STAR, Path
from lattica.sources.schema import field_of

_ELEMENT = "lattica_element"


def _field(path: list[str]) -> Column:
    c = F.col("`" + path[0].replace("`", "``") + "`")
    for name in path[1:]:
        c = c.getField(name)
    return c


def _replace(df: DataFrame, path: list[str], value: Column) -> DataFrame:
    """The frame with a nested field replaced."""
    if len(path) == 1:
        return df.withColumn(path[0], value)
    inner = value
    for depth in range(len(path) - 1, 0, -1):
        inner = _field(path[:depth]).withField(f"`{path[depth]}`", inner)
    return df.withColumn(path[0], inner)


def pruned(schema: T.StructType, wanted: list[list[str]]) -> T.StructType:
    """The schema without the fields that no wanted path leads to; of what is wanted as such, without fields, the first."""

    def cut(t: T.DataType, paths: list[list[str]]) -> T.DataType:
        if isinstance(t, T.ArrayType):
            return T.ArrayType(cut(t.elementType, paths))
        if not isinstance(t, T.StructType):
            return t
        names = {p[0] for p in paths if p}
        kept = [f for f in t.fields if f.name in names] or t.fields[:1]
        return T.StructType([T.StructField(f.name, cut(f.dataType, [p[1:] for p in paths if p and p[0] == f.name])) for f in kept])

    return cut(schema, wanted)


def flatten(df: DataFrame, path: Path) -> DataFrame:
    """Explode every `[*]` of the path, outer first; `a[i].b` becomes `a.b`. The path must end with `[*]`."""
    if path.steps[-1][1] != STAR:
        raise ValidationError("flatten needs a repeated field: field[*]")
    done: list[str] = []
    for name, index in path.steps:
        kind: T.DataType = df.schema
        for parent in done:
            kind = field_of(kind, parent, parent).dataType
        repeated = isinstance(field_of(kind, name, str(path)).dataType, T.ArrayType)
        done.append(name)
        if index not in (STAR, None) or repeated != (index == STAR):
            raise ValidationError(f"{name} in flatten({path}) is {'repeated' if repeated else 'not repeated'}")
        if repeated:
            df = df.withColumn(_ELEMENT, F.explode(_field(done)))
            df = _replace(df, done, F.col(_ELEMENT)).drop(_ELEMENT)
    return df
