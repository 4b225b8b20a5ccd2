"""Loads: files to registered tables, with quality gates."""

from __future__ import annotations

import hashlib
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.names import literal
from tarnlake.operators.columns import consistent_schema, with_date_parts, with_update_audit
from tarnlake.operators.contracts import validate_schema
from tarnlake.operators.enrich import apply_tool
from tarnlake.operators.quality import quality_gate
from tarnlake.plans.catalog import load_report
from tarnlake.sources.layouts import read_tables
from tarnlake.sources.readers import read_any
from tarnlake.sources.writers import (
    append, create_or_update_table, remove_path, replace_table, use_database, write_partitioned,
    write_table,
)
from tarnlake.types import catalog_name

PARTITION_KEYS = ["user_id", "year", "month", "day", "load_id"]


def ingest_file(
    spark: SparkSession,
    path: str,
    database: str,
    table: str,
    user: str,
    target: str,
    format: str | None = None,
    now: datetime | None = None,
    load_id: str | None = None,
    **options,
) -> DataFrame:
    """Read any file, add audit and date columns, write partitioned Parquet, register the table.

    A load of a user is named by ``load_id`` (by default a digest of the path) and owns the partition of that name: run
    again, on the same day or later, it replaces its own rows, while other loads of that user and day stay. The rows of
    an earlier run go last, so a failure leaves them until the load is run once more.
    """
    load = load_id or hashlib.sha256(path.encode()).hexdigest()[:16]
    rows = with_date_parts(
        with_update_audit(read_any(spark, path, format, **options), user, now), "updated_at"
    ).withColumn("load_id", F.lit(load))
    write_partitioned(rows, target, PARTITION_KEYS, dynamic=True)
    columns = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    create_or_update_table(spark, database, table, columns, location=target, partitions=PARTITION_KEYS)
    name = f"`{database}`.`{table}`"
    spark.catalog.recoverPartitions(name)
    _drop_earlier_runs(spark, name, target, user, load)
    return spark.table(name)


def _drop_earlier_runs(spark: SparkSession, name: str, target: str, user: str, load: str) -> None:
    """Drop the partitions that a load wrote on other days than the last one: at most one per run, found in the catalog."""
    mine = f"user_id = {literal(user)}, load_id = {literal(load)}"
    days = []
    for row in spark.sql(f"SHOW PARTITIONS {name} PARTITION ({mine})").collect():
        parts = dict(p.split("=", 1) for p in row["partition"].split("/"))
        days.append((int(parts["year"]), int(parts["month"]), int(parts["day"]), row["partition"]))
    for year, month, day, folder in sorted(days)[:-1]:
        spark.sql(f"ALTER TABLE {name} DROP IF EXISTS PARTITION ({mine}, year = {year}, month = {month}, day = {day})")
        remove_path(spark, f"{target}/{folder}")


def load_file(
    spark: SparkSession,
    path: str,
    database: str,
    table: str,
    location: str | None = None,
    format: str | None = None,
    **options,
) -> DataFrame:
    """Infer the schema, create the table, insert, and check the result: one row with the rows
    before, the rows read, the rows after and whether they add up."""
    rows = read_any(spark, path, format, **options)
    columns = {f.name: catalog_name(f.dataType) for f in rows.schema.fields}
    state = create_or_update_table(spark, database, table, columns, location=location)
    name = f"`{database}`.`{table}`"
    before = 0 if state == "created" else spark.table(name).count()
    read = append(rows, database, table)
    after = spark.table(name)
    total = after.count()
    return spark.createDataFrame(
        [(table, before, read, total, total == before + read, set(columns) <= set(after.columns))],
        "table_name string, rows_before bigint, rows_read bigint, rows_after bigint, "
        "complete boolean, same_columns boolean",
    )


def load_prefix(
    spark: SparkSession, prefix: str, database: str, target: str, extensions: list[str] | None = None
) -> DataFrame:
    """Load everything below a prefix into one table per name, and report one row per table.

    The files and folders directly below the prefix are the units; units whose names agree up to the first dot form
    one table. Its files may differ in format, order of columns, types and depth: columns meet by name, in a type that
    holds all their values, and ``key=value`` folders are columns (see :mod:`tarnlake.sources.layouts`).
    """
    use_database(spark, database)
    loaded, locations = {}, {}
    for table, rows in read_tables(spark, prefix, extensions).items():
        locations[table] = f"{target}/{table}"
        loaded[table] = write_table(rows, database, table, locations[table])
    if not loaded:  # no file, or files without a line
        return spark.createDataFrame([], "table_name string, column_count int, location string, row_count bigint")
    return load_report(loaded, locations)


def run_etl(
    spark: SparkSession,
    transformed: DataFrame,
    contract: list[dict],
    thresholds: dict[str, float],
    database: str,
    target: str,
    staging: str,
    location: str | None = None,
) -> DataFrame:
    """Stage the transformed rows, check contract and quality on the staged copy, and insert them
    into the target only when both pass. ``location`` is where a new target's files go (by default the
    warehouse). Returns the gate row with issues and the loaded rows."""
    transformed.write.mode("overwrite").parquet(staging)
    staged = spark.read.parquet(staging)
    issues = validate_schema(staged, contract).count()
    verdict = quality_gate(staged, thresholds)
    gate = verdict.first()
    loaded = 0
    if gate["passed"] and not issues:
        columns = {f.name: f.dataType.simpleString() for f in staged.schema.fields}
        create_or_update_table(spark, database, target, columns, location=location)
        loaded = append(staged, database, target)
    status = "completed" if gate["passed"] and not issues else "rejected"
    return spark.createDataFrame(
        [(*gate, issues, loaded, status)],
        verdict.schema.add("issues", "long").add("loaded_rows", "long").add("status", "string"),
    )


def upload(
    spark: SparkSession,
    path: str,
    database: str,
    table: str,
    target: str,
    format: str | None = None,
    **options,
) -> tuple[DataFrame, dict]:
    """Read any format, standardise names, write Parquet, register. Returns (table, record)."""
    rows, columns, renamed = consistent_schema(read_any(spark, path, format, **options))
    use_database(spark, database)
    written = write_table(rows, database, table, target)
    record = {
        "status": "success", "table": f"{database}.{table}", "location": target,
        "columns": columns, "renamed": renamed,
    }
    return written, record


def enrich_table(
    spark: SparkSession,
    database: str,
    table: str,
    tool_id: str,
    columns: list[str],
    path: str,
    staging: str,
    scorer=None,
) -> DataFrame:
    """Add the columns of a text tool to a stored Parquet table: read all files, drop empty rows, score, and replace
    the table, partitions as they were: with one write to a new folder below ``staging``, to which the catalog is pointed."""
    out = apply_tool(spark.read.parquet(path), tool_id, columns, scorer)
    return replace_table(out, database, table, staging)
