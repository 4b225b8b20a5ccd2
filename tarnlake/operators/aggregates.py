"""Aggregates. Every one is a hash aggregate with a map-side part, so hot keys shrink before the
shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlake.functions.numbers import to_number
from tarnlake.names import column as named
from tarnlake.names import literal
from tarnlake.operators.keys import present, row_counts, text_key
from tarnlake.operators.ranks import exact_quantiles

AGGREGATIONS = {
    "sum": F.sum, "average": F.avg, "avg": F.avg, "count": F.count, "min": F.min, "max": F.max,
}


def row_count(df: DataFrame, name: str = "row_count") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


def group_report(
    df: DataFrame, by: list[str], measure: str, count_as: str = "n", avg_as: str = "average"
) -> DataFrame:
    """Count and average per group, largest group first."""
    return (
        df.groupBy(*map(named, by))
        .agg(F.count(F.lit(1)).alias(count_as), F.avg(named(measure)).alias(avg_as))
        .orderBy(named(count_as).desc(), *map(named, by))
    )


def group_average(
    df: DataFrame, by: list[str], measure: str, name: str, above: float | None = None
) -> DataFrame:
    """Average per group; with ``above``, only groups whose average exceeds it."""
    out = df.groupBy(*map(named, by)).agg(F.avg(named(measure)).alias(name))
    return out if above is None else out.filter(named(name) > above)


def trend(df: DataFrame, time: Column, measure: str, as_: str, total_as: str) -> DataFrame:
    """Sum per point in time, rows without a time left out, in order of time."""
    return (
        df.filter(time.isNotNull())
        .groupBy(time.alias(as_))
        .agg(F.sum(named(measure)).alias(total_as))
        .orderBy(named(as_))
    )


def distribution(df: DataFrame, column: str, count_as: str = "n") -> DataFrame:
    return df.groupBy(named(column)).agg(F.count(F.lit(1)).alias(count_as))


def validity_counts(df: DataFrame, key: str, checks: dict[str, Column]) -> DataFrame:
    """Rows, distinct keys and the number of rows that pass each check, in one row."""
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_distinct(named(key)).alias("distinct_keys"),
        *[F.count_if(c).alias(name) for name, c in checks.items()],
    )


def chart_query(
    df: DataFrame, x: str, ys: list[str], aggregation: str = "sum", group_by: str | None = None
) -> DataFrame:
    """One aggregated series per y column over x (and over a second key when given)."""
    function = AGGREGATIONS[aggregation]
    keys = [x] if group_by in (None, x) else [x, group_by]
    return df.groupBy(*map(named, keys)).agg(*[function(named(y)).alias(y) for y in ys])


def column_statistic(df: DataFrame, column: str, operation: str) -> DataFrame:
    """One statistic over the values of a column that are numbers."""
    value = to_number(named(column), [])
    return df.agg(AGGREGATIONS[operation](value).alias(f"{column}_{operation}"))


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, std, min, quartiles and max, one row per numeric column.

    Quartiles are exact with linear interpolation, found by :func:`exact_quantiles`, so no task
    ever holds the values of a column.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    measures = {"count": "count", "mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}
    facts = df.selectExpr(
        *[
            f"CAST({fn}({present(n, types[n])}) AS {'BIGINT' if m == 'count' else 'DOUBLE'}) AS {m}_{i}"
            for i, n in enumerate(columns)
            for m, fn in measures.items()
        ]
    ).first()
    ends = {n: (facts[f"count_{i}"], facts[f"min_{i}"], facts[f"max_{i}"]) for i, n in enumerate(columns)}
    quartiles = exact_quantiles(df, columns, [0.25, 0.5, 0.75], ends)
    rows = [
        (n, facts[f"count_{i}"], facts[f"mean_{i}"], facts[f"std_{i}"], facts[f"min_{i}"],
         *quartiles[n], facts[f"max_{i}"])
        for i, n in enumerate(columns)
    ]
    return df.sparkSession.createDataFrame(
        rows,
        "column string, count bigint, mean double, std double, min double, q25 double, q50 double, "
        "q75 double, max double",
    )


def null_percentage(df: DataFrame, column: str) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(named(column).isNull()).alias("null_count"),
        (F.try_divide(F.count_if(named(column).isNull()), F.count(F.lit(1))) * 100).alias(
            "null_percentage"
        ),
    )


def pipeline_statistics(
    extracted: DataFrame, transformed: DataFrame, loaded: DataFrame, errors: DataFrame
) -> DataFrame:
    """Rows per stage, number of errors and the status, in one row.

    Each stage is counted on its own and only the four counts are brought together.
    """
    stages = {"extracted": extracted, "transformed": transformed, "loaded": loaded, "errors": errors}
    counts = reduce(
        DataFrame.unionAll,
        [
            df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(stage).alias("stage"), "n")
            for stage, df in stages.items()
        ],
    )
    of = {s: F.max(F.when(F.col("stage") == s, F.col("n"))) for s in stages}
    done = (of["errors"] == 0) & (of["loaded"] == of["transformed"])
    return counts.agg(
        of["extracted"].alias("total_records"),
        of["transformed"].alias("transformed_records"),
        of["loaded"].alias("loaded_records"),
        of["errors"].alias("error_count"),
        (of["errors"] > 0).alias("has_errors"),
        F.when(done, "completed").otherwise("in_progress").alias("status"),
    )


def enrichment_summary(
    df: DataFrame, label: str, confidence: str, positive: str, negative: str
) -> DataFrame:
    """Totals of an enriched table: labelled, failed, per label, average confidence."""
    c = named(label)
    return df.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count(c).alias("successful"),
        F.count_if(c.isNull()).alias("failed"),
        F.count_if(c == positive).alias("positive"),
        F.count_if(c == negative).alias("negative"),
        F.count_if(c.isNotNull() & ~c.isin(positive, negative)).alias("neutral"),
        F.avg(named(confidence)).alias("average_confidence"),
    )


def common_values(df: DataFrame, array_column: str, k: int, value_as: str = "value") -> DataFrame:
    """Most frequent elements of an array column."""
    return (
        df.select(F.explode(named(array_column)).alias(value_as))
        .groupBy(named(value_as))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), named(value_as))
        .limit(k)
    )


def overall_quality(metrics: DataFrame, scores: list[str]) -> DataFrame:
    """Unweighted mean of the scores of all tables; 0.0 when there is none."""
    return metrics.agg(*[F.coalesce(F.avg(named(s)), F.lit(0.0)).alias(s) for s in scores])


def duplicate_report(df: DataFrame) -> DataFrame:
    """Rows, distinct rows, duplicate rows and distinct values per column (nulls skipped)."""
    rows = (
        row_counts(df)
        .agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("different"))
        .select(
            F.expr(
                "stack(3, 'total_rows', total, 'distinct_rows', different, "
                "'duplicate_rows', total - different) AS (item, n)"
            )
        )
    )
    per_column = distinct_counts(df).select(
        F.concat(F.lit("distinct "), "column").alias("item"), F.col("distinct_count").alias("n")
    )
    return rows.select("item", F.coalesce("n", F.lit(0)).alias("n")).unionAll(per_column)


def distinct_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows, non-null values (NaN counts as null) and different values, one row per column.

    One scan for all columns: each row is unpivoted to (column, value), equal values are combined
    on the map side, and every (column, value) is shuffled once as a narrow key.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    names = columns or df.columns
    keys = df.selectExpr(*[f"{text_key(n, types[n])} AS k{i}" for i, n in enumerate(names)])
    labels = ", ".join(f"'k{i}', {literal(n)}" for i, n in enumerate(names))
    # an empty table still has one row per column
    empty = df.sparkSession.createDataFrame(
        [(f"k{i}", None, 0) for i in range(len(names))], "k string, value string, n bigint"
    )
    return (
        keys.unpivot([], [f"k{i}" for i in range(len(names))], "k", "value")
        .groupBy("k", "value")
        .agg(F.count(F.lit(1)).alias("n"))
        .unionAll(empty)
        .groupBy("k")
        .agg(
            F.expr("sum(n) AS row_count"),
            F.expr("coalesce(sum(CASE WHEN value IS NOT NULL THEN n END), 0L) AS valid_count"),
            F.expr("count(value) AS distinct_count"),
        )
        .selectExpr(
            f"element_at(map({labels}), k) AS column", "row_count", "valid_count", "distinct_count"
        )
    )
