"""Data quality on full tables.

Every score follows from three aggregates of the table, however many columns it has: one plain
aggregate (counts, ranges, variation, patterns), one over text lengths, one over row contents.
Nothing is sampled.
"""

from __future__ import annotations

from datetime import datetime
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnlake.functions.numbers import ratio
from tarnlake.names import literal, quoted, rows_of, struct_of
from tarnlake.operators.aggregates import distinct_counts
from tarnlake.operators.keys import known_first, present, row_counts
from tarnlake.types import catalog_name, is_number, is_text, spark_type

# Patterns of the three kinds of text a report looks for, anchored at the start.
TEXT_PATTERNS = {
    "email_pattern": r"^[\w\.-]+@[\w\.-]+\.\w+$",
    "phone_pattern": r"^\+?[\d\s-]{10,}$",
    "date_pattern": r"^\d{4}-\d{2}-\d{2}$",
}

# Score bounds of a quality status, as (success from, warning from).
STATUS_BANDS = {
    "completeness": (0.95, 0.85),
    "accuracy": (0.90, 0.80),
    "consistency": (0.85, 0.75),
}

# Metrics and thresholds of a quality run without a configuration.
DEFAULT_RUN = {
    "enabled_metrics": ["completeness", "uniqueness", "consistency"],
    "thresholds": {"completeness": 0.95, "uniqueness": 0.90, "consistency": 0.85},
}

MAX_LENGTHS = 3
MAX_VARIATION = 0.5


def _fields(df: DataFrame) -> list[tuple[int, T.StructField]]:
    return list(enumerate(df.schema.fields))


def _numbers(df: DataFrame) -> list[tuple[int, T.StructField]]:
    return [(i, f) for i, f in _fields(df) if is_number(f.dataType)]


def _texts(df: DataFrame) -> list[tuple[int, T.StructField]]:
    return [(i, f) for i, f in _fields(df) if is_text(f.dataType)]


def _table(one_row: DataFrame, structs: list[str], schema: str) -> DataFrame:
    """One row per struct of a one-row frame; without structs an empty frame."""
    if not structs:
        return one_row.sparkSession.createDataFrame([], schema)
    return one_row.selectExpr(rows_of(structs))


def _side_by_side(first: DataFrame, *others: DataFrame) -> DataFrame:
    """One-row frames as one row; the others are scalar sub-queries, so nothing is joined."""
    extra = {f"_{i}": frame.select(F.struct("*")).scalar() for i, frame in enumerate(others)}
    if not extra:
        return first
    return first.withColumns(extra).select(*first.columns, *[f"{name}.*" for name in extra])


# The plain aggregate, in parts that can be computed alone or together (SQL expressions).


def _count_parts(df: DataFrame) -> list[str]:
    """c0, c1, …: non-null values per column (NaN is null)."""
    return [f"count({present(f.name, f.dataType)}) AS c{i}" for i, f in _fields(df)]


def _variation_parts(df: DataFrame) -> list[str]:
    """v_i: sample standard deviation over mean of each numeric column."""
    return [
        f"try_divide(stddev_samp({c}), CAST(avg({c}) AS DOUBLE)) AS v{i}"
        for i, c in ((i, present(f.name, f.dataType)) for i, f in _numbers(df))
    ]


RANGES = {"min": "min", "max": "max", "mean": "avg", "std": "stddev_samp"}


def _range_parts(df: DataFrame) -> list[str]:
    return [
        f"CAST({fn}({present(f.name, f.dataType)}) AS DOUBLE) AS {name}{i}"
        for i, f in _numbers(df)
        for name, fn in RANGES.items()
    ]


# A cheap test that every match of a pattern passes ($ also matches before a last line break).
POSSIBLE = {
    "email_pattern": "contains({c}, '@')",
    "phone_pattern": "length({c}) >= 10",
    "date_pattern": "length({c}) BETWEEN 10 AND 11",
}


def _pattern_parts(df: DataFrame) -> list[str]:
    return [
        f"coalesce(bool_or({POSSIBLE[name].format(c=quoted(f.name))} AND "
        f"{quoted(f.name)} RLIKE {literal('(?U)' + pattern)}), false) AS {name}{i}"
        for i, f in _texts(df)
        for name, pattern in TEXT_PATTERNS.items()
    ]


def _facts(df: DataFrame, *parts: list[str]) -> DataFrame:
    """The plain aggregate of the given parts, and ``rows``."""
    return df.selectExpr("count(1) AS rows", *[p for part in parts for p in part])


def _lengths(df: DataFrame) -> DataFrame:
    """l_i: different lengths of each text column. Only lengths are expanded and shuffled."""
    names = [f"l{i}" for i, _ in _texts(df)]
    if not names:
        return df.sparkSession.range(1)
    lengths = df.selectExpr(*[f"length({quoted(f.name)}) AS l{i}" for i, f in _texts(df)])
    return lengths.selectExpr(*[f"count(DISTINCT {n}) AS {n}" for n in names])


# What the parts mean (SQL expressions over them).


def _completeness(df: DataFrame) -> dict[str, str]:
    width = len(df.columns)
    nulls = f"(rows * {width} - ({' + '.join(f'c{i}' for i in range(width))}))"
    return {
        "total_cells": f"rows * {width}",
        "null_cells": nulls,
        "completeness": f"1 - try_divide(CAST({nulls} AS DOUBLE), CAST(rows * {width} AS DOUBLE))",
    }


def _column_consistency(df: DataFrame, absolute: bool) -> list[dict[str, str]]:
    out = []
    for i, f in _fields(df):
        if is_number(f.dataType):
            kind, measure = "number", f"v{i}"
            good = f"{f'abs(v{i})' if absolute else f'v{i}'} < {MAX_VARIATION}D"
        elif is_text(f.dataType):
            kind, measure, good = "text", f"CAST(l{i} AS DOUBLE)", f"l{i} <= {MAX_LENGTHS}"
        else:
            kind, measure, good = "other", "CAST(NULL AS DOUBLE)", "false"
        out.append(
            {
                "column": literal(f.name), "kind": literal(kind), "measure": measure,
                "consistent": f"coalesce({good}, false)",
            }
        )
    return out


def _consistency(df: DataFrame, absolute: bool = False) -> dict[str, str]:
    flags = [f"CAST({c['consistent']} AS BIGINT)" for c in _column_consistency(df, absolute)]
    good, width = f"({' + '.join(flags)})", len(df.columns)
    return {
        "total_columns": f"{width}L",
        "consistent_columns": good,
        "consistency": f"CAST({good} AS DOUBLE) / {width}D",
    }


def _type_rows(df: DataFrame) -> dict[str, dict[str, str]]:
    return {
        f.name: {
            "expected_type": literal(catalog_name(f.dataType)),
            "valid_count": f"c{i}",
            "invalid_count": f"rows - c{i}",
        }
        for i, f in _fields(df)
    }


def _range_rows(df: DataFrame) -> dict[str, dict[str, str]]:
    return {f.name: {n: f"{n}{i}" for n in RANGES} for i, f in _numbers(df)}


def _pattern_rows(df: DataFrame) -> dict[str, dict[str, str]]:
    return {f.name: {n: f"{n}{i}" for n in TEXT_PATTERNS} for i, f in _texts(df)}


def _report(report: dict[str, dict[str, str]]) -> list[str]:
    return [struct_of({"column": literal(n), **fields}) for n, fields in report.items()]


def _as_map(report: dict[str, dict[str, str]]) -> str:
    return f"map({', '.join(f'{literal(n)}, {struct_of(fields)}' for n, fields in report.items())})"


def _named(expressions: dict[str, str]) -> list[str]:
    return [f"{e} AS {n}" for n, e in expressions.items()]


# The reports.


def completeness(df: DataFrame) -> DataFrame:
    """Cells, null cells (NaN included) and 1 - null share; an empty table has no score."""
    return _facts(df, _count_parts(df)).selectExpr(*_named(_completeness(df)))


def uniqueness(df: DataFrame) -> DataFrame:
    """Rows, duplicate rows and 1 - duplicate share; nulls are equal, the first copy is kept.

    Row contents are grouped by narrow keys, so long texts are shuffled as digests.
    """
    return (
        row_counts(df)
        .selectExpr(
            "coalesce(sum(n), 0L) AS total_rows", "coalesce(sum(n - 1), 0L) AS duplicate_rows"
        )
        .selectExpr(
            "*",
            "1 - try_divide(CAST(duplicate_rows AS DOUBLE), CAST(total_rows AS DOUBLE)) AS uniqueness",
        )
    )


def column_consistency(df: DataFrame, absolute: bool = False) -> DataFrame:
    """One row per column: kind, measure, consistent (text: at most 3 lengths; number: standard
    deviation below half the mean). Columns of other types are never consistent.

    The variation keeps its sign as in the score's definition; ``absolute`` compares its size.
    """
    facts = _side_by_side(_facts(df, _variation_parts(df)), _lengths(df))
    return facts.selectExpr(rows_of([struct_of(c) for c in _column_consistency(df, absolute)]))


def consistency(df: DataFrame, absolute: bool = False) -> DataFrame:
    """Columns, consistent columns and their share."""
    facts = _side_by_side(_facts(df, _variation_parts(df)), _lengths(df))
    return facts.selectExpr(*_named(_consistency(df, absolute)))


def type_report(df: DataFrame) -> DataFrame:
    """Type, valid (non-null) and invalid (null) values, one row per column."""
    return _facts(df, _count_parts(df)).selectExpr(rows_of(_report(_type_rows(df))))


def range_report(df: DataFrame) -> DataFrame:
    """min, max, mean and sample standard deviation, one row per numeric column."""
    schema = "column string, min double, max double, mean double, std double"
    return _table(_facts(df, _range_parts(df)), _report(_range_rows(df)), schema)


def pattern_report(df: DataFrame) -> DataFrame:
    """Whether any value of a text column is an e-mail, a phone number or an ISO date."""
    schema = "column string, " + ", ".join(f"{n} boolean" for n in TEXT_PATTERNS)
    return _table(_facts(df, _pattern_parts(df)), _report(_pattern_rows(df)), schema)


def column_quality(df: DataFrame) -> DataFrame:
    """Completeness, uniqueness (1 - repeats / rows, where nulls repeat too) and validity 1.0."""
    has_null = F.when(F.col("valid_count") < F.col("row_count"), 1).otherwise(0)
    return distinct_counts(df).select(
        "column",
        ratio(F.col("valid_count"), F.col("row_count")).alias("completeness"),
        ratio(F.col("distinct_count") + has_null, F.col("row_count")).alias("uniqueness"),
        F.lit(1.0).alias("validity"),
    )


def profile(df: DataFrame, order: str | None = None) -> DataFrame:
    """Column profile. ``redundancy`` is 1 - distinct / rows and decides ``is_unique``, odd as
    that is; ``distinct_ratio`` is the share of different values.

    The sample is the value of the first row in ``order`` that has one, else any value.
    """
    samples = []
    for i, f in _fields(df):
        c = f"CAST({quoted(f.name)} AS STRING)"
        if order:
            sample = f"min_by({c}, CASE WHEN {c} IS NOT NULL THEN {quoted(order)} END)"
        else:
            sample = f"any_value({c}, true)"
        samples.append(f"{sample} AS s{i}")
    described = {
        f.name: {"type": literal(catalog_name(f.dataType)), "sample_value": f"s{i}"}
        for i, f in _fields(df)
    }
    named = df.selectExpr(*samples).selectExpr(rows_of(_report(described)))
    complete = ratio(F.col("valid_count"), F.col("row_count"))
    distinct_ratio = ratio(F.col("distinct_count"), F.col("row_count"))
    return distinct_counts(df).join(named, "column").select(
        "column",
        "type",
        complete.alias("completeness"),
        (1 - distinct_ratio).alias("redundancy"),
        distinct_ratio.alias("distinct_ratio"),
        (complete > 0.95).alias("is_required"),
        (1 - distinct_ratio > 0.95).alias("is_unique"),
        "sample_value",
    )


def profile_score(profiled: DataFrame) -> DataFrame:
    """Mean over the columns of (completeness + redundancy) / 2; 1.0 without columns."""
    score = F.avg((F.col("completeness") + F.col("redundancy")) / 2)
    return profiled.agg(F.coalesce(score, F.lit(1.0)).alias("data_quality_score"))


def accuracy(df: DataFrame, declared: dict[str, str]) -> DataFrame:
    """Declared columns, those whose every non-null text is of the declared type, and their share.

    Columns are compared by name; a declared column the table lacks is not accurate.
    """
    failures = [
        f"count_if({quoted(n)} IS NOT NULL AND try_cast({quoted(n)} AS {spark_type(t)}) IS NULL) AS f{i}"
        for i, (n, t) in enumerate(declared.items())
        if n in df.columns
    ]
    flags = [f"CAST(f{i} = 0 AS BIGINT)" for i, n in enumerate(declared) if n in df.columns]
    good = f"({' + '.join(flags or ['0L'])})"
    return _facts(df, failures).selectExpr(
        f"{len(declared)}L AS declared_columns",
        f"{good} AS valid_columns",
        f"coalesce(try_divide(CAST({good} AS DOUBLE), {len(declared)}D), 0D) AS accuracy",
    )


def band(metric: str, score: Column) -> Column:
    """success, warning or error by the bounds of the metric."""
    success, warning = STATUS_BANDS[metric]
    return F.when(score >= success, "success").when(score >= warning, "warning").otherwise("error")


def quality_status(scores: DataFrame) -> DataFrame:
    """Add the status of each score column that has bounds."""
    return scores.withColumns(
        {f"{m}_status": band(m, F.col(m)) for m in STATUS_BANDS if m in scores.columns}
    )


def timeliness(df: DataFrame, time: str | None = None, since: Column | None = None) -> DataFrame:
    """1.0 without a rule; with a bound, the share of rows at or after it."""
    if time is None:
        return df.agg(F.lit(1.0).alias("timeliness"))
    fresh = F.count_if(F.col(time) >= since)
    return df.agg(ratio(fresh, F.count(F.lit(1))).alias("timeliness"))


def quality_record(df: DataFrame, now: datetime | None = None) -> DataFrame:
    """The whole quality record of a table as one row: counts, scores and per-column reports."""
    plain = _facts(
        df, _count_parts(df), _variation_parts(df), _range_parts(df), _pattern_parts(df)
    )
    facts = _side_by_side(plain, _lengths(df), uniqueness(df).select("uniqueness"))
    record = facts.selectExpr(
        "rows AS row_count",
        f"{len(df.columns)} AS column_count",
        f"{_completeness(df)['completeness']} AS completeness",
        "uniqueness",
        f"{_consistency(df)['consistency']} AS consistency",
        f"{_as_map(_type_rows(df))} AS type_validation",
        f"{_as_map(_range_rows(df))} AS range_checks",
        f"{_as_map(_pattern_rows(df))} AS pattern_checks",
    )
    checked = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    return record.withColumn("checked_at", checked)


def run_quality_checks(df: DataFrame, table: str, config: dict | None = None) -> DataFrame:
    """Chosen metrics with score, threshold, status and counts, one row per metric. Only the
    aggregates the chosen metrics need are computed, each once."""
    config = config or DEFAULT_RUN
    chosen = config["enabled_metrics"]
    measures = {
        "completeness": lambda: _completeness(df),
        "uniqueness": lambda: {n: n for n in ("total_rows", "duplicate_rows", "uniqueness")},
        "consistency": lambda: _consistency(df),
    }
    parts, others = [], []
    if "completeness" in chosen:
        parts.append(_count_parts(df))
    if "consistency" in chosen:
        parts.append(_variation_parts(df))
        others.append(_lengths(df))
    if "uniqueness" in chosen:
        others.append(uniqueness(df))
    rows = []
    for metric in chosen:
        total, part, score = measures[metric]().values()
        bound = float(config["thresholds"][metric])
        rows.append(
            struct_of(
                {
                    "table_name": literal(table),
                    "metric": literal(metric),
                    "score": score,
                    "threshold": f"{bound!r}D",
                    "status": f"CASE WHEN {score} >= {bound!r}D THEN 'success' ELSE 'warning' END",
                    "total": total,
                    "part": part,
                }
            )
        )
    schema = (
        "table_name string, metric string, score double, threshold double, status string, "
        "total bigint, part bigint"
    )
    return _table(_side_by_side(_facts(df, *parts), *others), rows, schema)


def latest_quality(history: DataFrame, table: str = "table_name", time: str = "checked_at") -> DataFrame:
    """The newest stored record per table; one without a time only where there is no other."""
    rest = [n for n in history.columns if n != table]
    return (
        history.groupBy(table)
        .agg(F.max_by(F.struct(*rest), known_first(time)).alias("_latest"))
        .select(table, *[F.col(f"_latest.`{n}`").alias(n) for n in rest])
    )


def quality_gate(df: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """Scores of a load and whether it may pass, as one row."""
    config = {"enabled_metrics": list(thresholds), "thresholds": thresholds}
    return run_quality_checks(df, "load", config).agg(
        F.bool_and(F.col("status") == "success").alias("passed"),
        *[F.max(F.when(F.col("metric") == m, F.col("score"))).alias(m) for m in thresholds],
    )
