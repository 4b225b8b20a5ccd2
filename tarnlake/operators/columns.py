"""Projections: names, types, audit and derived columns."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnlake.functions.json import safe_value
from tarnlake.functions.text import snake_name
from tarnlake.types import catalog_name, spark_type


def pick(df: DataFrame, columns: list[str], limit: int, order: list[str]) -> DataFrame:
    """Some columns of the first ``limit`` rows in the given order."""
    return df.orderBy(*order).limit(limit).select(*columns)


def standard_names(names: list[str]) -> list[str]:
    """Snake-case names; an empty name becomes ``col_i``, a repeated one gets ``_2``, ``_3``…"""
    taken: set[str] = set()
    out = []
    for i, name in enumerate(names):
        base = snake_name(name) or f"col_{i}"
        unique, n = base, 1
        while unique in taken:
            n += 1
            unique = f"{base}_{n}"
        taken.add(unique)
        out.append(unique)
    return out


def standardize_columns(df: DataFrame) -> DataFrame:
    """Rename every column to its standard name."""
    return df.toDF(*standard_names(df.columns))


def consistent_schema(df: DataFrame) -> tuple[DataFrame, list[dict], dict[str, str]]:
    """(renamed frame with the old names as column comments, catalog columns, old → new name)."""
    names = standard_names(df.columns)
    columns, described = [], []
    for field, name in zip(df.schema.fields, names):
        comment = f"Original column name: {field.name}"
        columns.append(
            F.col(f"`{field.name}`").alias(name, metadata={**field.metadata, "comment": comment})
        )
        described.append(
            {"name": name, "type": catalog_name(field.dataType), "description": comment}
        )
    return df.select(*columns), described, dict(zip(df.columns, names))


def apply_schema(df: DataFrame, fields: dict[str, str]) -> tuple[DataFrame, list[str]]:
    """(frame cast to the wanted types, columns left unchanged).

    A column is cast only when every non-null value converts. One aggregate pass over the columns
    in question decides; columns that are absent or already of the type cost nothing.
    """
    current = {f.name: f.dataType for f in df.schema.fields}
    wanted = {n: spark_type(t) for n, t in fields.items() if n in current}
    wanted = {n: t for n, t in wanted.items() if current[n].simpleString() != t}
    if not wanted:
        return df, []
    failures = df.agg(
        *[
            F.count_if(F.col(f"`{n}`").isNotNull() & F.col(f"`{n}`").try_cast(t).isNull()).alias(n)
            for n, t in wanted.items()
        ]
    ).first()
    kept = [n for n in wanted if failures[n]]
    casts = {n: F.col(f"`{n}`").try_cast(t) for n, t in wanted.items() if not failures[n]}
    return df.withColumns(casts), kept


def bucketize(c: Column, bounds: list[float], labels: list[str]) -> Column:
    """First label whose lower bound the value reaches, bounds in descending order; else the last."""
    out = F
    for bound, label in zip(bounds, labels):
        out = out.when(c >= F.lit(bound), F.lit(label))
    return out.otherwise(F.lit(labels[-1]))


def to_date(c: Column) -> Column:
    """Date of an ISO text, null when it is not one."""
    return c.try_cast("date")


def with_update_audit(df: DataFrame, user: str, now: datetime | None = None) -> DataFrame:
    """Add ``updated_at`` and ``user_id``."""
    return df.withColumns({"updated_at": _now(now), "user_id": F.lit(user)})


def with_record_audit(
    df: DataFrame, user: str, file_type: str, now: datetime | None = None
) -> DataFrame:
    """Add ``_created_at, _updated_at, _created_by, _updated_by, _file_type``."""
    return df.withColumns(
        {
            "_created_at": _now(now),
            "_updated_at": _now(now),
            "_created_by": F.lit(user),
            "_updated_by": F.lit(user),
            "_file_type": F.lit(file_type),
        }
    )


def _now(now: datetime | None) -> Column:
    return F.current_timestamp() if now is None else F.lit(now).cast("timestamp")


def with_date_parts(df: DataFrame, time_column: str) -> DataFrame:
    """Add ``year``, ``month`` and ``day``."""
    c = F.col(time_column)
    return df.withColumns({"year": F.year(c), "month": F.month(c), "day": F.dayofmonth(c)})


def json_safe(df: DataFrame) -> DataFrame:
    """Every value in a form JSON can hold."""
    return df.select(
        *[safe_value(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields]
    )


def missing_columns(df: DataFrame, columns: dict[str, str]) -> dict[str, str]:
    """The wanted columns (name → type) that the frame does not have yet, in any letter case."""
    have = {name.lower() for name in df.columns}
    return {n: t for n, t in columns.items() if n.lower() not in have}


def add_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add null columns of the given types, skipping names that exist."""
    return df.withColumns(
        {n: F.lit(None).cast(spark_type(t)) for n, t in missing_columns(df, columns).items()}
    )


def fields_frame(df: DataFrame) -> DataFrame:
    """The schema as rows (position, name, type); size of the schema only."""
    rows = [(i, f.name, catalog_name(f.dataType)) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position int, name string, type string")


