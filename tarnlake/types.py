"""One map between Spark types and the type names used in catalogs, contracts and reports."""

from __future__ import annotations

import re

from pyspark.sql import types as T

# Accepted type names and the Spark type each one means.
SPARK_TYPE_OF_NAME = {
    "int8": "bigint", "int16": "bigint", "int32": "bigint", "int64": "bigint",
    "int": "int", "integer": "int", "smallint": "smallint", "tinyint": "tinyint",
    "bigint": "bigint", "long": "bigint",
    "float32": "double", "float64": "double", "double": "double", "float": "float",
    "decimal": "decimal(10,2)", "numeric": "decimal(10,2)",
    "bool": "boolean", "boolean": "boolean",
    "object": "string", "string": "string", "category": "string", "str": "string",
    "varchar": "string", "text": "string", "char": "string", "json": "string", "time": "string",
    "datetime": "timestamp", "timestamp": "timestamp", "datetime64": "timestamp",
    "timestamp_ntz": "timestamp_ntz", "date": "date",
    "bytes": "binary", "blob": "binary", "binary": "binary",
}

# Catalog and relational names of the Spark types.
CATALOG_NAME = {
    T.ByteType: "bigint", T.ShortType: "bigint", T.IntegerType: "bigint", T.LongType: "bigint",
    T.FloatType: "double", T.DoubleType: "double",
    T.BooleanType: "boolean", T.StringType: "string", T.BinaryType: "binary",
    T.DateType: "date", T.TimestampType: "timestamp", T.TimestampNTZType: "timestamp",
}
RELATIONAL_NAME = {
    T.ByteType: "SMALLINT", T.ShortType: "SMALLINT", T.IntegerType: "INTEGER", T.LongType: "BIGINT",
    T.FloatType: "FLOAT", T.DoubleType: "DOUBLE",
    T.BooleanType: "BOOLEAN", T.StringType: "VARCHAR(255)", T.BinaryType: "BLOB",
    T.DateType: "DATE", T.TimestampType: "TIMESTAMP", T.TimestampNTZType: "TIMESTAMP",
    T.ArrayType: "JSON", T.MapType: "JSON", T.StructType: "JSON",
}


def spark_type(name: str) -> str:
    """Spark DDL type of a type name in any accepted spelling; an unknown name is a string."""
    text = name.strip().lower()
    if text.endswith(" null"):
        text = text[:-5].strip()
    if re.match(r"(struct|map|array)\s*<", text):
        # names of nested fields keep their letter case
        return re.sub(r"(?i)\s+null$", "", name.strip())
    if re.match(r"decimal\(\d+,\s*\d+\)$", text):
        return text
    base = re.sub(r"[\[(].*$", "", text).strip()
    return SPARK_TYPE_OF_NAME.get(base, "string")


def catalog_name(data_type: T.DataType) -> str:
    """Name stored in the catalog: every integer is bigint, every float is double."""
    if isinstance(data_type, (T.DecimalType, T.ArrayType, T.MapType, T.StructType)):
        return data_type.simpleString()
    return CATALOG_NAME.get(type(data_type), "string")


def relational_name(data_type: T.DataType, nullable: bool = False) -> str:
    """Name in a relational DDL; nested values are JSON text."""
    if isinstance(data_type, T.DecimalType):
        name = f"DECIMAL({data_type.precision},{data_type.scale})"
    else:
        name = RELATIONAL_NAME.get(type(data_type), "VARCHAR(255)")
    return f"{name} NULL" if nullable else name


def is_text(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.StringType, T.CharType, T.VarcharType))


def is_number(data_type: T.DataType) -> bool:
    return isinstance(data_type, T.NumericType)


def is_float(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.FloatType, T.DoubleType))
