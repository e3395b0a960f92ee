"""The three value types over Spark schemas, and reading fields with defaults in place of nulls.

Integers, booleans and times are LONG (times as microseconds since 1970), other numbers DOUBLE, the rest STRING.
A missing LONG is -1, a missing DOUBLE 0.0, a missing STRING empty, a missing array has length 0.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.errors import LoadError, ValidationError
from lattica.plans.tree import DOUBLE, LONG, STRING

SPARK_TYPE = {LONG: "bigint", DOUBLE: "double", STRING: "string"}
DEFAULT = {LONG: -1, DOUBLE: 0.0, STRING: ""}
CONTAINER = "CONTAINER"


def value_type(t: T.DataType) -> str:
    if isinstance(t, (T.IntegralType, T.BooleanType, T.TimestampType, T.TimestampNTZType, T.DateType)):
        return LONG
    if isinstance(t, T.NumericType):
        return DOUBLE
    if isinstance(t, (T.StringType, T.NullType)):
        return STRING
    raise LoadError(f"a field of type {t.simpleString()} has no value type")


def default(kind: str) -> Column:
    return F.lit(DEFAULT[kind]).cast(SPARK_TYPE[kind])


def raw(c: Column, t: T.DataType) -> Column:
    """The field in its value type, null where it is missing. Fields that fit already stay as they are."""
    if isinstance(t, (T.LongType, T.DoubleType, T.StringType)):
        return c
    if isinstance(t, T.DateType):
        return F.unix_date(c).cast("bigint") * F.lit(86_400_000_000)
    if isinstance(t, T.TimestampType):
        return F.unix_micros(c)
    if isinstance(t, T.TimestampNTZType):
        day = F.unix_date(c.cast("date")).cast("bigint") * F.lit(86_400_000_000)
        return day + F.hour(c).cast("bigint") * 3_600_000_000 + F.minute(c).cast("bigint") * 60_000_000 + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("bigint")
    return c.cast(SPARK_TYPE[value_type(t)])


def filled(c: Column, t: T.DataType) -> Column:
    return F.coalesce(raw(c, t), default(value_type(t)))


@dataclass(frozen=True)
class Field:
    """A field as the metadata shows it: its path without indexes, its type, and whether it is repeated."""

    name: str
    type: str
    repeated: bool


def fields(schema: T.StructType, prefix: str = "") -> list[Field]:
    out = []
    for f in schema.fields:
        t, repeated = f.dataType, isinstance(f.dataType, T.ArrayType)
        t = t.elementType if repeated else t
        if isinstance(t, T.ArrayType):
            raise LoadError(f"{prefix}{f.name} is a multi-dimensional array")
        if isinstance(t, T.StructType):
            out.append(Field(prefix + f.name, CONTAINER, repeated))
            out += fields(t, f"{prefix}{f.name}.")
        else:
            out.append(Field(prefix + f.name, value_type(t), repeated))
    return out


def field_of(schema: T.DataType, name: str, path: str) -> T.StructField:
    """The field of exactly that name; names are case-sensitive."""
    if isinstance(schema, T.StructType):
        for f in schema.fields:
            if f.name == name:
                return f
    raise ValidationError(f"there is no column {path}")


def normal_type(t: T.DataType) -> T.DataType:
    """The type that a field has once it is stored: value types only."""
    if isinstance(t, T.StructType):
        return T.StructType([T.StructField(f.name, normal_type(f.dataType)) for f in t.fields])
    if isinstance(t, T.ArrayType):
        if isinstance(t.elementType, T.ArrayType):
            raise LoadError("multi-dimensional arrays are not supported")
        return T.ArrayType(normal_type(t.elementType))
    return {LONG: T.LongType(), DOUBLE: T.DoubleType(), STRING: T.StringType()}[value_type(t)]


def normal(c: Column, t: T.DataType) -> Column:
    """The field with value types and defaults, all the way down."""
    if isinstance(t, T.StructType):
        return F.struct(*[normal(c.getField(f.name), f.dataType).alias(f.name) for f in t.fields])
    if isinstance(t, T.ArrayType):
        empty = F.array().cast(T.ArrayType(normal_type(t.elementType)))
        return F.coalesce(F.transform(c, lambda x: normal(x, t.elementType)), empty)
    return filled(c, t)
