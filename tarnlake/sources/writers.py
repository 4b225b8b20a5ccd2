"""Table writes, conversions and exports."""

from __future__ import annotations

import json
import uuid
from datetime import datetime
from urllib.parse import unquote

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tarnlake.names import literal
from tarnlake.operators.columns import missing_columns
from tarnlake.sources.readers import read_any
from tarnlake.types import spark_type


def _name(database: str, table: str) -> str:
    return f"`{database}`.`{table}`"


def use_database(spark: SparkSession, database: str, location: str | None = None) -> None:
    where = f" LOCATION {literal(location)}" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`{where}")


def write_table(df: DataFrame, database: str, table: str, path: str | None = None) -> DataFrame:
    """Write a snappy Parquet table (external when a path is given) and return it."""
    writer = df.write.mode("overwrite").format("parquet").option("compression", "snappy")
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(_name(database, table))
    return df.sparkSession.table(_name(database, table))


def convert(
    spark: SparkSession, source: str, target: str, target_format: str, source_format: str | None = None
) -> DataFrame:
    """Rewrite files in another format (parquet, orc, json, csv, or avro with its module)."""
    df = read_any(spark, source, source_format)
    write_as(df, target, target_format)
    return read_any(spark, target, "jsonl" if target_format == "json" else target_format)


def write_as(df: DataFrame, path: str, format: str) -> None:
    writer = df.write.mode("overwrite").format(format)
    if format == "csv":
        writer = writer.option("header", True)
    if format in ("parquet", "orc"):
        writer = writer.option("compression", "snappy")
    writer.save(path)


def export_csv(df: DataFrame, path: str) -> None:
    """CSV with a header in every part file; quotes inside values are doubled."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_partitioned(df: DataFrame, path: str, keys: list[str], dynamic: bool = False) -> None:
    """Hive-partitioned Parquet. ``dynamic`` replaces only the partitions present in ``df``.

    Rows are rebalanced by the keys: small partitions share a task, and a partition that holds
    much of the table is split into as many tasks (and files) as its size needs.
    """
    (
        df.hint("rebalance", *[F.col(k) for k in keys])
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic" if dynamic else "static")
        .partitionBy(*keys)
        .parquet(path)
    )


def create_or_update_table(
    spark: SparkSession,
    database: str,
    table: str,
    columns: dict[str, str],
    format: str = "parquet",
    location: str | None = None,
    partitions: list[str] | None = None,
    comments: dict[str, str] | None = None,
) -> str:
    """Create the table, or add the columns it lacks. Returns 'created' or 'updated'."""
    use_database(spark, database)
    name = _name(database, table)
    if spark.catalog.tableExists(name):
        add_table_columns(spark, database, table, columns)
        return "updated"
    ddl = ", ".join(
        f"`{n}` {spark_type(t)}"
        + (f" COMMENT {literal(comments[n])}" if comments and n in comments else "")
        for n, t in columns.items()
    )
    by = f" PARTITIONED BY ({', '.join(f'`{p}`' for p in partitions)})" if partitions else ""
    where = f" LOCATION {literal(location)}" if location else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({ddl}) USING {format}{by}{where}")
    return "created"


def add_table_columns(
    spark: SparkSession, database: str, table: str, columns: dict[str, str]
) -> list[str]:
    """Add the columns a table lacks; returns their names."""
    name = _name(database, table)
    new = missing_columns(spark.table(name), columns)
    if new:
        ddl = ", ".join(f"`{n}` {spark_type(t)}" for n, t in new.items())
        spark.sql(f"ALTER TABLE {name} ADD COLUMNS ({ddl})")
    return list(new)


def create_delimited_table(
    spark: SparkSession,
    database: str,
    table: str,
    path: str,
    columns: dict[str, str],
    sep: str = ",",
    quote: str = '"',
    escape: str = "\\",
    header: bool = True,
) -> DataFrame:
    """External table over delimited text files."""
    use_database(spark, database)
    ddl = ", ".join(f"`{n}` {spark_type(t)}" for n, t in columns.items())
    options = {"sep": sep, "quote": quote, "escape": escape, "header": str(header).lower()}
    option_text = ", ".join(f"{k} {literal(v)}" for k, v in options.items())
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {_name(database, table)} ({ddl}) USING csv "
        f"OPTIONS ({option_text}) LOCATION {literal(path)}"
    )
    return spark.table(_name(database, table))


def append(df: DataFrame, database: str, table: str) -> int:
    """INSERT INTO by column name; columns the frame lacks are null. Returns the rows written."""
    target = df.sparkSession.table(_name(database, table))
    have = set(df.columns)
    ordered = [
        (F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in target.schema.fields
    ]
    seen = Observation()
    counted = df.select(*ordered).observe(seen, F.count(F.lit(1)).alias("rows"))
    counted.write.insertInto(_name(database, table))
    return seen.get["rows"]


def ctas(
    spark: SparkSession, database: str, table: str, query: str, path: str | None = None, **frames
) -> DataFrame:
    """CREATE TABLE IF NOT EXISTS … AS SELECT; an existing table is left as it is."""
    name = _name(database, table)
    if not spark.catalog.tableExists(name):
        writer = spark.sql(query, **frames).write.format("parquet")
        (writer.option("path", path) if path else writer).saveAsTable(name)
    return spark.table(name)


def _write_checked(df: DataFrame, path: str, keys: list[str]) -> None:
    """Write Parquet and read it back: columns and row count must be those of ``df``, else the files go."""
    seen = Observation()
    observed = df.observe(seen, F.count(F.lit(1)).alias("rows"))
    try:
        if keys:
            write_partitioned(observed, path, keys)
        else:
            observed.write.mode("overwrite").option("compression", "snappy").parquet(path)
        # the files say what was written; a table without rows has no partition folders to read
        copy = df.sparkSession.read.parquet(path) if not keys or not df.isEmpty() else df
        if sorted(copy.columns) != sorted(df.columns):
            raise ValueError(f"written columns {copy.columns} differ from {df.columns}")
        expected, got = seen.get["rows"], copy.count()
        if got != expected:
            raise ValueError(f"written {got} of {expected} rows")
    except Exception:
        remove_path(df.sparkSession, path)
        raise


def staged_overwrite(df: DataFrame, target: str, staging: str, keys: list[str] | None = None) -> DataFrame:
    """Replace the Parquet folder ``target``, partitioned by ``keys``, which ``df`` may itself read.

    The rows are written once, to ``staging``, and read back; only when columns and row count agree does the staging
    folder take the target's place, by renaming, and the old files go last. Until then the target stays as it
    is. Where renaming is slow or not atomic (object stores), replace the table of a catalog: :func:`replace_table`.
    """
    spark = df.sparkSession
    _write_checked(df, staging, keys or [])
    old = f"{target.rstrip('/')}-{uuid.uuid4().hex[:12]}"
    moved = path_exists(spark, target) and _rename(spark, target, old)
    try:
        if not _rename(spark, staging, target):
            raise OSError(f"cannot rename {staging} to {target}")
    except Exception:
        if moved:
            _rename(spark, old, target)
        raise
    if moved:
        remove_path(spark, old)
    return spark.read.parquet(target)


def replace_table(df: DataFrame, database: str, table: str, folder: str) -> DataFrame:
    """Replace all rows of an external Parquet table, which ``df`` may itself read; partitions as they were, new columns
    added.

    The rows are written once, to a new folder below ``folder``, and read back; then the catalog is pointed there and the old
    folder goes last. A failure before leaves the table as it was, and the new folder goes.
    """
    spark, name = df.sparkSession, _name(database, table)
    keys = [c.name for c in spark.catalog.listColumns(name) if c.isPartition]
    described = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE TABLE EXTENDED {name}").collect()}
    if described.get("Type") != "EXTERNAL":
        raise ValueError(f"{name} is not external: its files go with its partitions")
    old, new = described["Location"], f"{folder.rstrip('/')}/{uuid.uuid4().hex}"
    _write_checked(df, new, keys)
    try:
        add_table_columns(spark, database, table, {f.name: f.dataType.simpleString() for f in df.schema.fields})
        _point(spark, name, new, bool(keys))
    except Exception:
        _point(spark, name, old, bool(keys))
        remove_path(spark, new)
        raise
    remove_path(spark, old)
    return spark.table(name)


def _point(spark: SparkSession, name: str, folder: str, partitioned: bool) -> None:
    """Let the catalog read an external table from another folder."""
    spark.sql(f"ALTER TABLE {name} SET LOCATION {literal(folder)}")
    if partitioned:
        for row in spark.sql(f"SHOW PARTITIONS {name}").collect():
            parts = [p.split("=", 1) for p in row["partition"].split("/")]
            spec = ", ".join(f"`{k}` = {literal(unquote(v))}" for k, v in parts if v != "__HIVE_DEFAULT_PARTITION__")
            if len(parts) == spec.count(" = "):
                spark.sql(f"ALTER TABLE {name} DROP IF EXISTS PARTITION ({spec})")
        spark.catalog.recoverPartitions(name)
    spark.catalog.refreshTable(name)


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def _rename(spark: SparkSession, source: str, target: str) -> bool:
    old, new = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (source, target))
    return old.getFileSystem(spark._jsc.hadoopConfiguration()).rename(old, new)


def remove_path(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def store_docs(docs: DataFrame, path: str, kind: str) -> None:
    """Append metadata documents (key, at, doc as JSON) to the folder of their kind."""
    rows = docs.select(F.lit(kind).alias("kind"), "key", F.col("at").cast("timestamp"), "doc")
    rows.write.mode("append").partitionBy("kind").parquet(path)


def store_doc(
    spark: SparkSession, path: str, kind: str, key: str, doc: dict, at: datetime
) -> None:
    """Append one metadata document."""
    row = [(key, at, json.dumps(doc, sort_keys=True, default=str))]
    store_docs(spark.createDataFrame(row, "key string, at timestamp, doc string"), path, kind)
