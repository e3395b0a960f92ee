"""Reading JSON, CSV and Parquet files as tables of value types, and writing tables.

JSON files hold an array of objects, or an object a line; a missing or null field becomes the default of its type.
Files with an object a line are split into tasks. A file that holds an array is read by one task, whatever its size;
``convert`` turns it once into files that split.
CSV files need a header; columns are STRING unless told otherwise, and empty cells become the default.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.errors import LoadError
from lattica.plans.tree import DOUBLE, LONG, STRING
from lattica.sources.metadata import merge_schemas, table_fields
from lattica.sources.schema import DEFAULT, SPARK_TYPE, normal, raw, value_type

FORMATS = ("json", "csv", "parquet")


def _checked(types: Mapping[str, str]) -> dict[str, str]:
    out = {k: v.upper() for k, v in types.items()}
    for name, kind in out.items():
        if kind not in SPARK_TYPE:
            raise LoadError(f"{name}: there is no type {kind}")
    return out


def normalise(df: DataFrame) -> DataFrame:
    """All fields in value types with defaults for what is missing."""
    table_fields(df.schema)  # raises for what has no value type
    return df.select(*[normal(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def _retyped(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """An explicit type may turn a field into STRING; any other disagreement is an error."""
    for name, kind in types.items():
        field = next((f for f in df.schema.fields if f.name == name), None)
        if field is None:
            continue
        if isinstance(field.dataType, (T.StructType, T.ArrayType)):
            raise LoadError(f"{name} has fields or repeats; it cannot be {kind}")
        found = value_type(field.dataType)
        if found != kind and kind != STRING and not (found == LONG and kind == DOUBLE):
            raise LoadError(f"{name} is {found} in the file, not {kind}")
        if found != kind:
            df = df.withColumn(name, F.col(f"`{name}`").cast(SPARK_TYPE[kind]))
    return df


def _parsed(name: str, kind: str) -> Column:
    """A CSV cell; an empty one is the default, one that cannot be read is an error."""
    text = F.col(f"`{name}`")
    if kind == STRING:
        return F.coalesce(text, F.lit("")).alias(name)
    bad = F.raise_error(F.concat(F.lit(f"{name}: not a {kind}: "), text)).cast(SPARK_TYPE[kind])
    empty = text.isNull() | (F.trim(text) == "")
    return F.when(empty, F.lit(DEFAULT[kind]).cast(SPARK_TYPE[kind])).otherwise(F.coalesce(F.trim(text).try_cast(SPARK_TYPE[kind]), bad)).alias(name)


def _by_lines(spark: SparkSession, path: str) -> bool:
    """Does each line of the files hold an object of its own; judged by their first line that is not blank."""
    first = spark.read.text(path).where(F.trim("value") != "").select(F.ltrim("value").alias("value")).first()
    if first is None or not first["value"].startswith("{"):
        return False
    try:
        return isinstance(json.loads(first["value"]), dict)
    except ValueError:
        return False


def read_json(spark: SparkSession, path: str | Sequence[str], types: Mapping[str, str] | None = None) -> DataFrame:
    paths = [path] if isinstance(path, str) else list(path)
    lines = [p for p in paths if _by_lines(spark, p)]
    found = []
    for whole, of in ((False, lines), (True, [p for p in paths if p not in lines])):
        if of:
            found.append(spark.read.option("multiLine", whole).option("mode", "FAILFAST").option("prefersDecimal", False).json(of))
    parts = [normalise(_retyped(df, _checked(types or {}))) for df in found]
    return parts[0] if len(parts) == 1 else union(parts)


def read_csv(spark: SparkSession, path: str | Sequence[str], types: Mapping[str, str] | None = None, default_type: str = STRING) -> DataFrame:
    kinds = _checked(types or {})
    rest = _checked({"defaultColumnType": default_type})["defaultColumnType"]
    df = spark.read.option("header", True).option("enforceSchema", False).csv([path] if isinstance(path, str) else list(path))
    unknown = set(kinds) - set(df.columns)
    if unknown:
        raise LoadError(f"no such columns: {', '.join(sorted(unknown))}")
    return df.select(*[_parsed(c, kinds.get(c, rest)) for c in df.columns])


def read_parquet(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Files as they are: value types and defaults are put in where a statement reads a field, so that filters and
    column choice reach the files."""
    return spark.read.parquet(*([path] if isinstance(path, str) else path))


def read(spark: SparkSession, kind: str, path: str | Sequence[str], types: Mapping[str, str] | None = None, default_type: str = STRING) -> DataFrame:
    if kind == "json":
        return read_json(spark, path, types)
    if kind == "csv":
        return read_csv(spark, path, types, default_type)
    if kind == "parquet":
        return _retyped(read_parquet(spark, path), _checked(types or {}))
    raise LoadError(f"there is no format {kind}; there are {', '.join(FORMATS)}")


def union(parts: Sequence[DataFrame]) -> DataFrame:
    """Several inputs as one table: the union of their fields, with defaults where an input has none."""
    return normalise(united(parts))


def united(parts: Sequence[DataFrame]) -> DataFrame:
    """``union`` with nulls in place of defaults, which a statement puts in where it reads a field.

    A field that has a value type already stays as it is, so filters and the choice of columns reach the files of each
    part as they do for a table of one part.
    """
    merged = merge_schemas([p.schema for p in parts])
    out = None
    for p in parts:
        kinds = {f.name: f.dataType for f in p.schema.fields}
        shaped = p.select(*[_shape(F.col(f"`{f.name}`") if f.name in kinds else None, kinds.get(f.name), f.dataType).alias(f.name) for f in merged.fields])
        out = shaped if out is None else out.unionByName(shaped)
    if out is None:
        raise LoadError("there is nothing to unite")
    return out


def _shape(c: Column | None, have: T.DataType | None, want: T.DataType) -> Column:
    """A field in the merged type, null where it is missing."""
    if c is None or have is None:
        return F.lit(None).cast(want)
    if have.simpleString() == want.simpleString():
        return c
    if isinstance(want, T.ArrayType):
        return F.transform(c, lambda x: _shape(x, have.elementType, want.elementType))
    if isinstance(want, T.StructType):
        mine = {f.name: f.dataType for f in have.fields}
        return F.struct(*[_shape(c.getField(f.name) if f.name in mine else None, mine.get(f.name), f.dataType).alias(f.name) for f in want.fields])
    return raw(c, have)


def write(df: DataFrame, path: str, comment: str = "", mode: str = "error", files: int | None = None, file_mb: float | None = None) -> None:
    """Write a table in value types as Parquet; the comment goes into the files' schema metadata.

    ``file_mb``: a task begins another file after so many MB, judged by the length of the first thousand rows as text.
    """
    out = normalise(df)
    if comment and out.columns:
        first = out.columns[0]
        out = out.withMetadata(first, {"comment": comment})
    writer = (out.coalesce(files) if files else out).write.mode(mode)
    if file_mb is not None:
        length = out.limit(1000).select(F.avg(F.length(F.to_json(F.struct("*"))))).first()[0] or 1.0
        writer = writer.option("maxRecordsPerFile", max(1, int(file_mb * 2**20 / length)))
    writer.parquet(path)


def info(spark: SparkSession, path: str) -> dict[str, object]:
    """Rows, files and comment of a written table; only the footers are read."""
    df = spark.read.parquet(path)
    comment = next((f.metadata["comment"] for f in df.schema.fields if "comment" in f.metadata), "")
    return {"rows": df.count(), "files": len(df.inputFiles()), "comment": comment, "fields": [tuple(vars(f).values()) for f in table_fields(df.schema)]}


def convert(spark: SparkSession, kind: str, source: str | Sequence[str], target: str, types: Mapping[str, str] | None = None, default_type: str = STRING, comment: str = "") -> None:
    write(read(spark, kind, source, types, default_type), target, comment)


def merge(spark: SparkSession, sources: Sequence[str], target: str, comment: str = "") -> None:
    write(union([spark.read.parquet(s) for s in sources]), target, comment)


class RowBuilder:
    """Builds rows for ``SparkSession.createDataFrame`` field by field; rejects values of mixed types."""

    def __init__(self) -> None:
        self._row: dict[str, object] = {}

    @staticmethod
    def _kind(v: object) -> str:
        if isinstance(v, RowBuilder):
            return "object"
        if isinstance(v, bool) or not isinstance(v, (int, float, str)):
            raise LoadError(f"{v!r} is no LONG, DOUBLE or STRING")
        return LONG if isinstance(v, int) else DOUBLE if isinstance(v, float) else STRING

    def with_data(self, name: str, value: int | float | str | RowBuilder) -> RowBuilder:
        if name in self._row:
            raise LoadError(f"{name} has a value already")
        self._kind(value)
        self._row[name] = value
        return self

    def add_repeated(self, name: str, *values: int | float | str | RowBuilder) -> RowBuilder:
        held = self._row.setdefault(name, [])
        if not isinstance(held, list):
            raise LoadError(f"{name} is not repeated")
        kinds = {self._kind(v) for v in (*held, *values)}
        if len(kinds) > 1:
            raise LoadError(f"{name} mixes {', '.join(sorted(kinds))}")
        held.extend(values)
        return self

    def build(self) -> dict[str, object]:
        plain = lambda v: v.build() if isinstance(v, RowBuilder) else [plain(x) for x in v] if isinstance(v, list) else v
        return {k: plain(v) for k, v in self._row.items()}
