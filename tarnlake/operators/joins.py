"""Joins. No side is ever broadcast by hand: Spark chooses from the sizes it knows or measures,
and splits skewed partitions of the larger side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.names import column, quoted


def left_report(
    left: DataFrame,
    right: DataFrame,
    left_key: str,
    right_key: str,
    measure: str,
    by: list[str],
    count_as: str = "n",
    sum_as: str = "total",
) -> DataFrame:
    """Count and sum of the matching right rows per left group, largest sum first, no match last.

    The right side is reduced to one row per key before the join, so a key with very many rows
    is combined on the map side and never meets the join as a hot key.
    """
    per_key = right.groupBy(column(right_key).alias("_key")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(column(measure)).alias("_sum")
    )
    return (
        left.join(per_key, column(left_key) == F.col("_key"), "left")
        .groupBy(*map(column, by))
        .agg(
            F.coalesce(F.sum("_n"), F.lit(0)).alias(count_as),
            F.sum("_sum").alias(sum_as),
        )
        .orderBy(column(sum_as).desc_nulls_last(), *map(column, by))
    )


def inner_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Inner equi-join with the key kept under its left name; other columns of the right side whose name
    the left side has too end in ``_right``."""
    taken = set(left.columns)
    named = {n: n if n not in taken else f"{n}_right" for n in right.columns if n != right_key}
    other = right.select(F.col(quoted(right_key)).alias("_key"), *[F.col(quoted(n)).alias(a) for n, a in named.items()])
    return left.join(other, F.col(quoted(left_key)) == F.col("_key"), "inner").drop("_key")


def with_stored_metadata(
    tables: DataFrame, stored: DataFrame, key: str, override: list[str], newest: str
) -> DataFrame:
    """Table list in which stored values replace the own ones where present, newest first."""
    own, other = tables.alias("own"), stored.alias("stored")
    columns = [
        F.coalesce(F.col(f"stored.{quoted(n)}"), F.col(f"own.{quoted(n)}")).alias(n)
        if n in override
        else F.col(f"own.{quoted(n)}").alias(n)
        for n in tables.columns
    ]
    return (
        own.join(other, F.col(f"own.{quoted(key)}") == F.col(f"stored.{quoted(key)}"), "left")
        .select(*columns)
        .orderBy(column(newest).desc_nulls_last(), column(key))
    )


def compare_columns(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Names of two schemas side by side: only_left, only_right or common.

    Both sides are made distinct first, so repeats of one name cost nothing in the join.
    """
    a = left.select(*map(column, keys)).distinct().withColumn("in_left", F.lit(True))
    b = right.select(*map(column, keys)).distinct().withColumn("in_right", F.lit(True))
    return a.join(b, keys, "full").select(
        *map(column, keys),
        F.when(F.col("in_left").isNull(), "only_right")
        .when(F.col("in_right").isNull(), "only_left")
        .otherwise("common")
        .alias("status"),
    )
