"""SQL and parameterised report queries."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.operators.aggregates import AGGREGATIONS
from tarnlake.operators.filters import where_all


def query(spark: SparkSession, text: str, database: str | None = None, **args: Any) -> DataFrame:
    """Run a SQL text (SELECT, CREATE TABLE AS, INSERT …) and return its typed rows.

    DataFrames among ``args`` may be used as ``{name}``, other values as ``:name``.
    """
    if database:
        spark.sql(f"USE `{database}`")
    frames = {k: v for k, v in args.items() if isinstance(v, DataFrame)}
    values = {k: v for k, v in args.items() if k not in frames}
    return spark.sql(text, args=values or None, **frames)


def report_query(
    df: DataFrame,
    filters: list[dict[str, Any]] | None = None,
    group_by: list[str] | None = None,
    measures: dict[str, tuple[str, str]] | None = None,
    having: dict[str, Any] | None = None,
    order: list[tuple[str, str]] | None = None,
    limit: int | None = None,
    columns: list[str] | None = None,
) -> DataFrame:
    """A stored report: filter, group, aggregate (name → (function, column)), having, order, limit."""
    out = where_all(df, filters or [])
    if measures:
        aggregated = [
            AGGREGATIONS[function](F.lit(1) if column == "*" else F.col(column)).alias(name)
            for name, (function, column) in measures.items()
        ]
        out = out.groupBy(*(group_by or [])).agg(*aggregated)
        if having:
            out = where_all(out, [having])
    if columns:
        out = out.select(*columns)
    if order:
        out = out.orderBy(
            *[
                F.col(c).desc_nulls_last() if direction == "desc" else F.col(c).asc_nulls_last()
                for c, direction in order
            ]
        )
    return out if limit is None else out.limit(limit)


def department_report(people: DataFrame, department: str, measure: str) -> DataFrame:
    """The report run at the end of a load: size and average per department."""
    return report_query(
        people,
        group_by=[department],
        measures={"n": ("count", "*"), "average": ("avg", measure)},
        order=[("n", "desc"), (department, "asc")],
    )
