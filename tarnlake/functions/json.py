"""JSON text and nested columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnlake.functions.repair import repaired_column
from tarnlake.functions.text import let, strip


def strip_fences(c: Column) -> Column:
    """Text without Markdown code fences."""
    return strip(_replace_if(c, ("```",), r"```(?:json)?", ""))


def _replace_if(c: Column, hints: tuple[str, ...], pattern: str, replacement: str) -> Column:
    """Replace by a pattern in texts that contain one of the hints (any text without hints)."""
    if not hints:
        return F.regexp_replace(c, pattern, replacement)

    def replaced(v: Column) -> Column:
        possible = reduce(lambda a, b: a | b, [v.contains(h) for h in hints])
        return F.when(possible, F.regexp_replace(v, pattern, replacement)).otherwise(v)

    return let(c, replaced)


def parse_response(c: Column, schema: str, required: list[str]) -> Column:
    """Struct parsed from a fenced or plain JSON answer; null when it does not parse or a
    required field is missing."""

    def checked(parsed: Column) -> Column:
        fields = [parsed.getField(name).isNotNull() for name in required]
        return F.when(reduce(lambda a, b: a & b, fields, F.lit(True)), parsed)

    return let(F.from_json(strip_fences(c), schema, {"mode": "PERMISSIVE"}), checked)


def repair_json(c: Column) -> Column:
    """Valid JSON text from lenient JSON; text that parses already is returned unchanged, repaired
    text (see :mod:`tarnlake.functions.repair`) in compact form, and text that cannot be repaired is null."""

    def checked(plain: Column) -> Column:
        good = F.try_parse_json(plain).isNotNull()
        # only text that does not parse is sent to Python
        fixed = repaired_column(F.when(~good, plain))
        return F.when(good, plain).otherwise(F.to_json(F.try_parse_json(fixed)))

    return checked(strip_fences(c))


def get_path(c: Column, path: str) -> Column:
    """Text at a dotted path of a JSON column; null when a step is missing."""
    return F.get_json_object(c, "$." + path)


def is_nullable(value: Column) -> Column:
    """Aggregate: true when any row has no value."""
    return F.bool_or(value.isNull())


def leaf_paths(
    schema: T.StructType, above: tuple[str, ...] = ()
) -> list[tuple[tuple[str, ...], T.StructField]]:
    """(steps of the path, field) of every leaf; arrays and maps are leaves."""
    leaves = []
    for field in schema.fields:
        steps = (*above, field.name)
        if isinstance(field.dataType, T.StructType):
            leaves += leaf_paths(field.dataType, steps)
        else:
            leaves.append((steps, field))
    return leaves


def path_column(steps: tuple[str, ...]) -> Column:
    return F.col(".".join(f"`{step}`" for step in steps))


def flatten(df: DataFrame) -> DataFrame:
    """One column per leaf, named by its dotted path; lists and maps are kept as JSON text."""
    columns = []
    for steps, field in leaf_paths(df.schema):
        value = path_column(steps)
        if isinstance(field.dataType, (T.ArrayType, T.MapType)):
            value = F.to_json(value)
        columns.append(value.alias(".".join(steps)))
    return df.select(*columns)


def unwrap(df: DataFrame) -> DataFrame:
    """Records of a one-field document that holds a list of objects; other frames unchanged."""
    if len(df.schema.fields) == 1:
        field = df.schema.fields[0]
        if isinstance(field.dataType, T.ArrayType) and isinstance(
            field.dataType.elementType, T.StructType
        ):
            return df.select(F.inline(F.col(f"`{field.name}`")))
    return df


def lift_details(result: Column, prefix: str = "is_ai_company") -> list[Column]:
    """Top-level columns of a categorisation result whose answer sits in ``details``."""
    details = result.getField("details")
    return [
        details.getField("is_ai_company").alias(prefix),
        result.getField("confidence").alias(f"{prefix}_ai_confidence"),
        details.getField("reasoning").alias(f"{prefix}_ai_reasoning"),
    ]


def safe_value(c: Column, data_type: T.DataType) -> Column:
    """JSON-safe form of a value: NaN is null, times are ISO text, nested values likewise."""
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(c), c)
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    if isinstance(data_type, T.DateType):
        return F.date_format(c, "yyyy-MM-dd")
    if isinstance(data_type, T.ArrayType):
        return F.transform(c, lambda x: safe_value(x, data_type.elementType))
    if isinstance(data_type, T.MapType):
        return F.transform_values(c, lambda _, v: safe_value(v, data_type.valueType))
    if isinstance(data_type, T.StructType):
        fields = [
            safe_value(c.getField(f.name), f.dataType).alias(f.name) for f in data_type.fields
        ]
        return F.when(c.isNotNull(), F.struct(*fields))
    return c
