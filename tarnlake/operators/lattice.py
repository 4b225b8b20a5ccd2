"""Schemas that differ: the least type that holds the values of both, and rows brought to it by column name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnlake.names import quoted
from tarnlake.types import is_float

NESTED = (T.StructType, T.ArrayType, T.MapType)


def widened(a: T.DataType, b: T.DataType) -> T.DataType:
    """The least type that holds the values of both: whole numbers and decimals grow, a number and a float are double,
    a date and a time are a time, nested types meet field by field, and all other pairs are text."""
    if isinstance(a, T.NullType) or a == b:
        return b
    if isinstance(b, T.NullType):
        return a
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        return merged_schema([a, b])
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(widened(a.elementType, b.elementType))
    if isinstance(a, T.MapType) and isinstance(b, T.MapType):
        return T.MapType(widened(a.keyType, b.keyType), widened(a.valueType, b.valueType))
    if isinstance(a, T.NumericType) and isinstance(b, T.NumericType):
        if is_float(a) or is_float(b):
            return T.DoubleType()
        if isinstance(a, T.DecimalType) or isinstance(b, T.DecimalType):
            a, b = (x if isinstance(x, T.DecimalType) else T.DecimalType(20, 0) for x in (a, b))
            scale = max(a.scale, b.scale)
            digits = max(a.precision - a.scale, b.precision - b.scale) + scale
            return T.DecimalType(digits, scale) if digits <= 38 else T.DoubleType()
        return T.LongType()
    times = (T.DateType, T.TimestampNTZType, T.TimestampType)
    if isinstance(a, times) and isinstance(b, times):
        return max(a, b, key=lambda t: times.index(type(t)))
    return T.StringType()


def merged_schema(schemas: list[T.StructType]) -> T.StructType:
    """All fields, in the order in which they first appear, names matched without regard to case."""
    found: dict[str, T.StructField] = {}
    for schema in schemas:
        for field in schema.fields:
            plain = nullable(field.dataType)
            known = found.get(field.name.lower())
            kind = widened(known.dataType, plain) if known else plain
            found[field.name.lower()] = T.StructField(known.name if known else field.name, kind, True, field.metadata)
    return T.StructType(list(found.values()))


def nullable(kind: T.DataType) -> T.DataType:
    """The same type with nulls allowed everywhere."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, nullable(f.dataType), True, f.metadata) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(nullable(kind.elementType))
    if isinstance(kind, T.MapType):
        return T.MapType(nullable(kind.keyType), nullable(kind.valueType))
    return kind


def conformed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of ``schema`` (as :func:`merged_schema` gives it) by name; those that the frame lacks are null."""
    have = {f.name.lower(): f for f in df.schema.fields}
    return df.select(
        *[
            (_as(F.col(quoted(have[f.name.lower()].name)), have[f.name.lower()].dataType, f.dataType)
             if f.name.lower() in have else F.lit(None).cast(f.dataType)).alias(f.name, metadata=f.metadata)
            for f in schema.fields
        ]
    )


def _as(c: Column, have: T.DataType, want: T.DataType) -> Column:
    if nullable(have) == want:
        return c
    if isinstance(have, T.StructType) and isinstance(want, T.StructType):
        fields = {f.name.lower(): f for f in have.fields}
        parts = [
            (_as(c.getField(fields[f.name.lower()].name), fields[f.name.lower()].dataType, f.dataType)
             if f.name.lower() in fields else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in want.fields
        ]
        return F.when(c.isNotNull(), F.struct(*parts))
    if isinstance(have, T.ArrayType) and isinstance(want, T.ArrayType):
        return F.transform(c, lambda x: _as(x, have.elementType, want.elementType))
    if isinstance(have, T.MapType) and isinstance(want, T.MapType):
        keys = F.transform(F.map_keys(c), lambda x: _as(x, have.keyType, want.keyType))
        values = F.transform(F.map_values(c), lambda x: _as(x, have.valueType, want.valueType))
        return F.map_from_arrays(keys, values)
    if isinstance(have, NESTED):
        return F.to_json(c)
    return c.cast(want)
