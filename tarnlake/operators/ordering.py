"""Sorting, top-k and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnlake.names import quoted


def top_k(df: DataFrame, measure: str, k: int, tie: list[str]) -> DataFrame:
    """The k largest rows: each task keeps k rows, nothing else is shuffled."""
    return df.orderBy(F.col(measure).desc_nulls_last(), *tie).limit(k)


def sort_nulls_last(
    df: DataFrame, column: str, direction: str = "asc", tie: list[str] | None = None
) -> DataFrame:
    """Total order with nulls at the end in both directions.

    The tie columns (by default all others) belong to the range partitioning, so one very frequent
    value is still spread over many tasks.
    """
    c = F.col(column)
    key = c.asc_nulls_last() if direction == "asc" else c.desc_nulls_last()
    if tie is None:
        tie = [
            f.name for f in df.schema.fields
            if f.name != column and isinstance(f.dataType, T.AtomicType)
        ]
    return df.orderBy(key, *tie)


def first_rows(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    return df.orderBy(*order).limit(n)


#: rows that a task may keep to skip to a page
AT_ONCE = 100_000


def page(df: DataFrame, number: int, size: int, order: list[str], shallow: int = AT_ONCE) -> DataFrame:
    """Page ``number`` (from 0) of ``size`` rows in the given total order, nulls first, by columns of any type.

    Every task keeps as many rows as lie before the end of the page. Where these are more than ``shallow``, the order
    columns alone are dealt out by ranges and counted per range; of the rows only those between the ends of the ranges
    that hold the page are read on, and dealt out again while too many of them come before the page. Rows that are equal
    in all order columns have no defined order, and ranges cannot tell them apart.
    """
    offset, rows = number * size, df
    while offset + size > shallow:
        ranges = _ranges(rows, order)
        before, held = 0, []
        for count, low, high in ranges:
            if before < offset + size and before + count > offset:
                held.append((before, low, high))
            before += count
        if not held:
            return df.limit(0)
        if len(held) == len(ranges):
            break
        offset -= held[0][0]
        rows = df.filter(_between(df, order, held[0][1], held[-1][2]))
    return rows.orderBy(*[F.col(quoted(c)) for c in order]).offset(offset).limit(size)


def _ranges(df: DataFrame, order: list[str]) -> list[tuple[int, Row, Row]]:
    """(rows, smallest, largest) of the ranges of an order; one row per range comes to the driver."""
    keys = [F.col(quoted(c)).alias(f"_{i}") for i, c in enumerate(order)]
    types = {f.name: f.dataType for f in df.schema.fields}
    parts = max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    key = F.struct(*[f"_{i}" for i in range(len(order))])
    found = (
        df.select(*keys)
        .repartitionByRange(parts, *[f"_{i}" for i in range(len(order))])
        .groupBy(F.spark_partition_id().alias("part"))
        .agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("low"), F.max(key).alias("high"))
    )
    ends = [
        F.struct(*[_carried(F.col(f"{end}._{i}"), types[c]).alias(f"_{i}") for i, c in enumerate(order)]).alias(end)
        for end in ("low", "high")
    ]
    return [(r["n"], r["low"], r["high"]) for r in sorted(found.select("part", "n", *ends).collect(), key=lambda r: r["part"])]


def _carried(c: Column, data_type: T.DataType) -> Column:
    """A value in a form that comes to the driver and back unchanged."""
    if isinstance(data_type, T.TimestampType):
        return F.unix_micros(c)
    return c.cast("string") if isinstance(data_type, T.TimestampNTZType) else c


def _value(value, data_type: T.DataType) -> Column:
    if isinstance(data_type, T.TimestampType) and value is not None:
        return F.timestamp_micros(F.lit(value))
    return F.lit(bytes(value) if isinstance(value, bytearray) else value).cast(data_type)


def _between(df: DataFrame, order: list[str], low: Row, high: Row) -> Column:
    """Rows from ``low`` to ``high``: by the first column, which scans can use, and by all columns together."""
    types = {f.name: f.dataType for f in df.schema.fields}
    names = [f"_{i}" for i in range(len(order))]
    key = F.struct(*[F.col(quoted(c)).alias(n) for c, n in zip(order, names, strict=True)])
    least, most = (
        F.struct(*[_value(v, types[c]).alias(n) for v, c, n in zip(end, order, names, strict=True)]) for end in (low, high)
    )
    first, kind = F.col(quoted(order[0])), types[order[0]]
    inside = (key >= least) & (key <= most)
    if high[0] is None:
        return inside & first.isNull()
    below = first <= _value(high[0], kind)
    return inside & ((first.isNull() | below) if low[0] is None else (first >= _value(low[0], kind)) & below)


def newest_first(df: DataFrame, time: str, tie: list[str] | None = None) -> DataFrame:
    """Newest rows first, rows without a time last."""
    return sort_nulls_last(df, time, "desc", tie)
