"""Set operations on names and rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnlake.operators.joins import compare_columns
from tarnlake.names import column, quoted
from tarnlake.operators.keys import row_key, row_keys
from tarnlake.operators.lattice import conformed, merged_schema


def schema_sets(left: DataFrame, right: DataFrame, name: str) -> DataFrame:
    """Names of two schemas by side (only_left, only_right, common), in sorted order."""
    return compare_columns(left, right, [name]).orderBy("status", column(name))


def schema_set_counts(left: DataFrame, right: DataFrame, name: str) -> DataFrame:
    """Number of names per side."""
    return compare_columns(left, right, [name]).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def drop_duplicates(df: DataFrame, order: str | None = None) -> DataFrame:
    """One copy of every row; null equals null.

    Without ``order`` all columns are compared. With ``order`` that column is left out of the
    comparison and the row with its smallest value is kept, one without a value only where there is no
    other.
    """
    if order is None:
        if all(isinstance(f.dataType, T.AtomicType) and not isinstance(f.dataType, T.StringType) for f in df.schema):
            return df.dropDuplicates()
        # digests travel as keys, not texts; a map cannot be compared but by its key
        return df.withColumn("_row", row_key(df, df.columns)).dropDuplicates(["_row"]).drop("_row")
    rest = [n for n in df.columns if n != order]
    last = F.struct(F.col(quoted(order)).isNull().alias("missing"), F.col(quoted(order)).alias("value"))
    kept = df.groupBy(*map(F.expr, row_keys(df, rest))).agg(
        F.min_by(F.struct(*map(quoted, df.columns)), last).alias("_row")
    )
    return kept.select(*[F.col(f"_row.{quoted(n)}").alias(n) for n in df.columns])


def concatenate(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames, columns matched by name in any letter case; a missing column is null, and a column of
    differing types has one that holds all its values (see :func:`tarnlake.operators.lattice.widened`)."""
    schema = merged_schema([f.schema for f in frames])
    return reduce(DataFrame.unionAll, [conformed(f, schema) for f in frames])
