"""Running totals per key in a given order, for keys of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnlake.names import quoted
from tarnlake.session import keep


def running_totals(
    df: DataFrame, keys: list[str], order: list[str | Column], totals: dict[str, str | Column]
) -> DataFrame:
    """For each name in ``totals``, the sum of that column over the rows of the same key that come
    earlier in ``order`` (0 for the first one).

    Rows are dealt out by ranges of (key, order) of even size, so a key that holds a third of the
    table lies in many ranges and no key is sorted as a whole. Inside a range the totals are a
    window; what earlier ranges of the key hold is added from one row per (range, key). Rows that
    tie in ``order`` follow each other in no defined order: give a column that separates them.
    """
    spread = [F.col(quoted(k)) for k in keys]
    by = [F.col(quoted(c)) if isinstance(c, str) else c for c in order]
    amounts = {n: F.col(quoted(c)) if isinstance(c, str) else c for n, c in totals.items()}
    # a struct is never null, so rows without a key keep their place in the join
    rows = df.withColumns({f"_add_{n}": c for n, c in amounts.items()}).withColumn(
        "_slot", F.struct(F.struct(*spread, F.lit(0).alias("_")).alias("key"))
    )
    ranged = rows.repartitionByRange(*spread, *by) if spread or by else rows
    ranged = ranged.withColumn(
        "_slot", F.struct(F.col("_slot.key").alias("key"), F.spark_partition_id().alias("part"))
    )
    ranged = keep(ranged, "ranges")

    earlier = Window.partitionBy("_slot.key").orderBy("_slot.part")
    earlier = earlier.rowsBetween(Window.unboundedPreceding, -1)
    before = (
        ranged.groupBy("_slot")
        .agg(*[F.sum(f"_add_{n}").alias(f"_sum_{n}") for n in amounts])
        .select(
            "_slot", *[F.coalesce(F.sum(f"_sum_{n}").over(earlier), F.lit(0)).alias(f"_before_{n}") for n in amounts]
        )
    )
    inside = Window.partitionBy("_slot").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    return (
        ranged.withColumns(
            {f"_inside_{n}": F.coalesce(F.sum(f"_add_{n}").over(inside), F.lit(0)) for n in amounts}
        )
        .join(before, "_slot")
        .select(
            *[F.col(quoted(c)) for c in df.columns],
            *[(F.col(f"_inside_{n}") + F.col(f"_before_{n}")).alias(n) for n in amounts],
        )
    )
