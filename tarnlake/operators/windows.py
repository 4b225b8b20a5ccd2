"""Repeats and versions: the reference loops that become windows once the data is a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnlake.names import quoted
from tarnlake.operators.keys import known_first, row_key
from tarnlake.operators.running import running_totals


def duplicate_positions(df: DataFrame, position: str) -> DataFrame:
    """Rows that repeat an earlier row in every column but ``position``, with the first position.

    A window over the whole row would send all copies of a hot row to one task. Here the first
    position per row content is a map-side aggregate, and only contents that do repeat are joined
    back (a skewed join partition is split by Spark).
    """
    compared = [n for n in df.columns if n != position]
    keyed = df.withColumn("_row", row_key(df, compared))
    first = (
        keyed.groupBy("_row")
        .agg(F.min(position).alias("first_position"), F.count(F.lit(1)).alias("_n"))
        .filter("_n > 1")
        .select("_row", "first_position")
    )
    return (
        keyed.join(first, "_row")
        .filter(F.col(position) > F.col("first_position"))
        .drop("_row")
    )


def latest_version(versions: DataFrame, key: str, version: str) -> DataFrame:
    """The row with the highest version per key, a row without a version only where there is no other: an
    aggregate, so no key travels as a whole."""
    rest = [n for n in versions.columns if n != key]
    return (
        versions.groupBy(quoted(key))
        .agg(F.max_by(F.struct(*map(quoted, rest)), known_first(version)).alias("_latest"))
        .select(quoted(key), *[F.col(f"_latest.{quoted(n)}").alias(n) for n in rest])
        .select(*map(quoted, versions.columns))
    )


def numbered(
    df: DataFrame,
    key: str,
    order: str,
    bucket: Column | None = None,
    number_as: str = "number",
    after: DataFrame | None = None,
) -> DataFrame:
    """1, 2, 3 … per key in order, without ever sorting one key in one task.

    By default rows are dealt out by ranges of (key, order) of even size, for any type that sorts. A
    ``bucket`` that never decreases along ``order`` (a day, an id range) saves that: rows are numbered
    inside (key, bucket), and the running total of the bucket sizes is added, a window over one row per
    bucket only. ``after`` (key, start) holds a number per key to count on from.
    """
    if bucket is None:
        ties = [n for n in df.columns if n not in (key, order) and isinstance(df.schema[n].dataType, T.AtomicType)]
        rows = running_totals(df, [key], [order, *ties], {number_as: F.lit(1)})
        number = F.col(quoted(number_as)) + 1
        if after is not None:
            start = after.toDF("_start_key", "_start")
            rows = rows.join(start, F.col(quoted(key)).eqNullSafe(F.col("_start_key")), "left")
            number = number + F.coalesce("_start", F.lit(0))
        return rows.select(*map(quoted, df.columns), number.cast("long").alias(number_as))
    # a struct of both is never null, so rows without a key are kept and the join needs no shuffle
    # beyond the window's
    rows = df.withColumn("_slot", F.struct(F.col(key).alias("key"), bucket.alias("bucket")))
    before = Window.partitionBy("_slot.key").orderBy("_slot.bucket")
    before = before.rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy("_slot")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    )
    if after is not None:
        start = after.toDF("_start_key", "_start")
        offsets = offsets.join(start, F.col("_slot.key").eqNullSafe(F.col("_start_key")), "left")
        offsets = offsets.withColumn("_before", F.col("_before") + F.coalesce("_start", F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("_slot").orderBy(order))
    return (
        rows.withColumn("_inside", inside)
        .join(offsets.select("_slot", "_before"), "_slot")
        .withColumn(number_as, (F.col("_before") + F.col("_inside")).cast("long"))
        .select(*df.columns, number_as)
    )


def add_versions(
    versions: DataFrame, new: DataFrame, key: str, order: str, bucket: Column | None = None
) -> DataFrame:
    """New rows with the next version numbers of their key, starting at 1 for a new key."""
    current = versions.groupBy(key).agg(F.max("version").alias("start"))
    return numbered(new, key, order, bucket, "version", current)


def register_new(versions: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """First versions only: rows whose key has no version yet."""
    known = versions.select(key).distinct()
    return new.join(known, key, "left_anti").withColumn("version", F.lit(1).cast("long"))
