"""Catalog rows, schema changes and the audit log."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnlake.functions.json import leaf_paths, path_column
from tarnlake.operators.columns import fields_frame
from tarnlake.operators.windows import latest_version
from tarnlake.types import catalog_name, relational_name

INVENTORY = "table string, column string, position int, type string, comment string, location string"


def column_inventory(spark: SparkSession, database: str) -> DataFrame:
    """One row per column of every table of a database (metadata only, no table is read)."""
    rows = []
    for t in spark.catalog.listTables(database):
        if t.isTemporary:
            continue
        name = f"`{database}`.`{t.name}`"
        detail = {
            r["col_name"]: r["data_type"]
            for r in spark.sql(f"DESCRIBE TABLE EXTENDED {name}").collect()
        }
        for i, f in enumerate(spark.table(name).schema.fields):
            comment = f.metadata.get("comment")
            rows.append((t.name, f.name, i, catalog_name(f.dataType), comment, detail.get("Location")))
    return spark.createDataFrame(rows, INVENTORY)


def preview(df: DataFrame, order: list[str], rows: int = 5) -> DataFrame:
    """First rows in the given order, each with the total number of rows."""
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return df.orderBy(*order).limit(rows).withColumn("total_rows", total)


def infer_schema(df: DataFrame) -> DataFrame:
    """Name, type, nullable and a sample value per column; one short read for the samples."""
    first = df.limit(1).select(
        *[F.col(f"`{f.name}`").cast("string").alias(f.name) for f in df.schema.fields]
    ).first()
    rows = [
        (f.name, catalog_name(f.dataType), f.nullable, first[f.name] if first else None)
        for f in df.schema.fields
    ]
    return df.sparkSession.createDataFrame(
        rows, "name string, type string, nullable boolean, sample string"
    )


def relational_schema(df: DataFrame) -> DataFrame:
    """(name, type, nullable) per leaf of nested records; nullable is true when any record has no
    value at the path. All paths are checked in one aggregate."""
    leaves = leaf_paths(df.schema)
    missing = df.agg(
        *[
            F.coalesce(F.bool_or(path_column(steps).isNull()), F.lit(True)).alias(f"m{i}")
            for i, (steps, _) in enumerate(leaves)
        ]
    )
    rows = [
        F.struct(
            F.lit(".".join(steps)).alias("name"),
            F.lit(_relational(field.dataType)).alias("type"),
            F.col(f"m{i}").alias("nullable"),
        )
        for i, (steps, field) in enumerate(leaves)
    ]
    return missing.select(F.inline(F.array(*rows)))


def _relational(data_type: T.DataType) -> str:
    # Spark infers every JSON number as long or double; the relational names of both are fixed.
    if isinstance(data_type, T.LongType):
        return "INTEGER"
    if isinstance(data_type, T.DoubleType):
        return "FLOAT"
    return relational_name(data_type)


def schema_changes(old: DataFrame, new: DataFrame, keys: list[str], value: str = "type") -> DataFrame:
    """added, removed, modified and unchanged fields of two versions, with old and new value.

    ``keys`` name a field (for example table and name) and are unique in each version.
    """
    a = old.select(*keys, F.col(value).alias("old_type"), F.lit(True).alias("_a"))
    b = new.select(*keys, F.col(value).alias("new_type"), F.lit(True).alias("_b"))
    return a.join(b, keys, "full").select(
        *keys,
        F.when(F.col("_a").isNull(), "added")
        .when(F.col("_b").isNull(), "removed")
        .when(~F.col("old_type").eqNullSafe(F.col("new_type")), "modified")
        .otherwise("unchanged")
        .alias("change"),
        "old_type",
        "new_type",
    )


def schema_evolution(old: DataFrame, new: DataFrame, keys: list[str], value: str = "type") -> DataFrame:
    """Only the fields that changed."""
    return schema_changes(old, new, keys, value).filter("change <> 'unchanged'")


def merge_schemas(
    old: DataFrame, new: DataFrame, keys: list[str], at: datetime, value: str = "type"
) -> DataFrame:
    """Fields of the new version: unchanged as they are, modified with the time of the change,
    added; removed fields are gone."""
    return (
        schema_changes(old, new, keys, value)
        .filter("change <> 'removed'")
        .select(
            *keys,
            F.col("new_type").alias(value),
            "change",
            F.when(F.col("change") == "modified", F.lit(at).cast("timestamp")).alias("modified_at"),
        )
    )


def schema_hash(columns: DataFrame, table: str, parts: list[str], name: str = "version_hash") -> DataFrame:
    """One hash per table that changes exactly when its set of column rows changes.

    The column digests are added up, so the hash does not depend on row order and no table's
    columns are gathered in one place.
    """
    text = F.concat_ws(":", *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts])
    digest = F.md5(text)

    def part(start: int) -> Column:
        return F.conv(F.substring(digest, start, 12), 16, 10).cast("decimal(38,0)")

    return (
        columns.groupBy(table)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(part(1)).cast("string").alias("a"),
            F.sum(part(13)).cast("string").alias("b"),
        )
        .select(table, F.md5(F.concat_ws("|", F.col("n").cast("string"), "a", "b")).alias(name))
    )


def changed_tables(before: DataFrame, after: DataFrame, table: str, name: str = "version_hash") -> DataFrame:
    """Tables that are new or whose hash differs from the previous run."""
    previous = before.select(table, F.col(name).alias("_previous"))
    return (
        after.join(previous, table, "left")
        .filter(~F.col(name).eqNullSafe(F.col("_previous")))
        .drop("_previous")
    )


def audit_rows(
    log: DataFrame, table: str, start: datetime | None = None, end: datetime | None = None,
    table_column: str = "table_name", time: str = "at",
) -> DataFrame:
    """Audit entries of a table within an optional time range."""
    out = log.filter(F.col(table_column) == table)
    if start is not None:
        out = out.filter(F.col(time) >= F.lit(start))
    if end is not None:
        out = out.filter(F.col(time) <= F.lit(end))
    return out


def lineage(log: DataFrame, source: str, target: str, step: str, time: str) -> DataFrame:
    """One row per (source, target): number of steps, different steps and the time span."""
    return log.groupBy(F.col(source).alias("source"), F.col(target).alias("target")).agg(
        F.count(F.lit(1)).alias("steps"),
        F.count_distinct(F.col(step)).alias("step_kinds"),
        F.min(time).alias("first_at"),
        F.max(time).alias("last_at"),
    )


def load_report(tables: dict[str, DataFrame], locations: dict[str, str] | None = None) -> DataFrame:
    """Columns, location and rows of each loaded table."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"),
            F.lit(len(df.columns)).alias("column_count"),
            F.lit((locations or {}).get(name)).cast("string").alias("location"),
            "row_count",
        )
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionAll, parts)


def version_of(spark: SparkSession, database: str, table: str) -> DataFrame:
    """Current schema hash of one catalog table."""
    fields = fields_frame(spark.table(f"`{database}`.`{table}`")).withColumn("table", F.lit(table))
    return schema_hash(fields, "table", ["name", "type"])


def current_schemas(versions: DataFrame, name: str = "name", version: str = "version") -> DataFrame:
    """Newest schema version of each name."""
    return latest_version(versions, name, version)
