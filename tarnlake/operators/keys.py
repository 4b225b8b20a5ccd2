"""Grouping keys that keep shuffles narrow, as SQL expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnlake.names import quoted, struct_of

LONG_TEXT = 64


def narrow_key(name: str, data_type: T.DataType) -> str:
    """A groupable stand-in for a column: equal exactly when the values are equal.

    Text longer than 64 characters is replaced by '#' and its SHA-256 (65 characters, so it can
    not meet a short value); a whole document never travels through a shuffle as a key. Nested
    values become text first (a map with its entries sorted).
    """
    c = quoted(name)
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return f"{c} + CAST(0 AS {data_type.simpleString()})"  # -0.0 and 0.0 are one value
    if isinstance(data_type, T.MapType):
        c = f"to_json({sorted_maps(c, data_type)}, {EXACT_TIMES})"
    elif isinstance(data_type, (T.ArrayType, T.StructType)):
        c = f"to_json({sorted_maps(c, data_type)}, {EXACT_TIMES})"
    elif isinstance(data_type, T.BinaryType):
        c = f"base64({c})"
    elif not isinstance(data_type, T.StringType):
        return c
    return f"CASE WHEN length({c}) > {LONG_TEXT} THEN concat('#', sha2({c}, 256)) ELSE {c} END"


def known_first(order: str) -> Column:
    """An order for max_by in which a null comes before all values, so that no row is lost with it."""
    return F.struct(F.col(quoted(order)).isNotNull().alias("known"), F.col(quoted(order)).alias("value"))


# Times inside JSON keys to the microsecond.
EXACT_TIMES = "map('timestampFormat', 'yyyy-MM-dd\\'T\\'HH:mm:ss.SSSSSSXXX', 'timestampNTZFormat', 'yyyy-MM-dd\\'T\\'HH:mm:ss.SSSSSS')"


def sorted_maps(c: str, data_type: T.DataType, depth: int = 0) -> str:
    """A nested value with the entries of all its maps in the order of their keys."""
    x = f"x{depth}"
    if isinstance(data_type, T.MapType):
        entries = f"sort_array(map_entries({c}))"
        value = sorted_maps(f"{x}.value", data_type.valueType, depth + 1)
        if value == f"{x}.value":
            return entries
        return f"transform({entries}, {x} -> named_struct('key', {x}.key, 'value', {value}))"
    if isinstance(data_type, T.ArrayType):
        element = sorted_maps(x, data_type.elementType, depth + 1)
        return c if element == x else f"transform({c}, {x} -> {element})"
    if isinstance(data_type, T.StructType):
        fields = {f.name: sorted_maps(f"{c}.{quoted(f.name)}", f.dataType, depth) for f in data_type.fields}
        if all(e == f"{c}.{quoted(n)}" for n, e in fields.items()):
            return c
        return f"if({c} IS NULL, NULL, {struct_of(fields)})"
    return c


def row_keys(df: DataFrame, columns: list[str] | None = None) -> list[str]:
    """Key expressions that stand for a whole row (or the given columns)."""
    types = {f.name: f.dataType for f in df.schema.fields}
    return [narrow_key(name, types[name]) for name in columns or df.columns]


def row_counts(df: DataFrame) -> DataFrame:
    """``n`` per different row content; the contents themselves are left behind."""
    keys = [f"{key} AS k{i}" for i, key in enumerate(row_keys(df))]
    grouped = df.selectExpr(*keys).groupBy(*[f"k{i}" for i in range(len(keys))])
    return grouped.agg(F.count(F.lit(1)).alias("n"))


def row_key(df: DataFrame, columns: list[str]) -> Column:
    """The keys of a row as one struct: never null, and equal where all columns are equal or null,
    so it can be joined and partitioned by."""
    return F.expr(f"struct({', '.join(row_keys(df, columns))})")


def text_key(name: str, data_type: T.DataType) -> str:
    """A key as text, null for null and NaN; equal exactly when the values are equal."""
    key = narrow_key(name, data_type)
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        key = f"CASE WHEN NOT isnan({quoted(name)}) THEN {key} END"
    return f"CAST({key} AS STRING)"


def present(name: str, data_type: T.DataType) -> str:
    """The column with NaN as null, so that counts skip both."""
    c = quoted(name)
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return f"CASE WHEN NOT isnan({c}) THEN {c} END"
    return c
