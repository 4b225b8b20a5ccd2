"""Column cleaning and the runner for ordered, recorded cleaning steps."""

from __future__ import annotations

from datetime import date
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlake.functions.numbers import is_whole, to_number
from tarnlake.functions.text import collapse_spaces
from tarnlake.functions.times import parse_time
from tarnlake.names import quoted
from tarnlake.types import is_text

# Defaults of the cleaning steps.
NULL_TEXT = "UNKNOWN"
UNKNOWN_EMAIL = "unknown@example.com"
MIN_CONFIDENCE = 0.7


def fill_nulls(df: DataFrame, columns: list[str], value: Any = NULL_TEXT) -> DataFrame:
    """Fill nulls; a column of another type than the value becomes text when the value is text."""
    types = {f.name: f.dataType for f in df.schema.fields}
    filled = {}
    for name in columns:
        c = F.col(f"`{name}`")
        if isinstance(value, str) and not is_text(types[name]):
            c = c.cast("string")
        filled[name] = F.coalesce(c, F.lit(value))
    return df.withColumns(filled)


def convert_types(
    df: DataFrame, columns: list[str], fill: int = 0, known: dict[str, bool] | None = None
) -> DataFrame:
    """Numbers of text columns. A column of whole numbers that fit becomes bigint, digit for digit, with
    nulls filled; any other becomes double with nulls kept.

    The type depends on the data, so one aggregate over the columns runs first, but for those of which ``known``
    says whether they are whole.
    """
    known = known or {}
    whole = known | whole_columns(df, [n for n in columns if n not in known])
    converted = {}
    for n in columns:
        number = to_number(F.col(quoted(n)))
        exact = exact_whole(F.col(quoted(n)), number)
        converted[n] = F.coalesce(exact, F.lit(fill).cast("bigint")) if whole[n] else number
    return df.withColumns(converted)


def whole_columns(df: DataFrame, columns: list[str]) -> dict[str, bool]:
    """Whether all numbers of a column are whole and fit bigint; one aggregate for all columns."""
    if not columns:
        return {}
    checks = []
    for i, n in enumerate(columns):
        number = to_number(F.col(quoted(n)))
        fits = number.isNull() | exact_whole(F.col(quoted(n)), number).isNotNull()
        checks.append(F.coalesce(F.every(fits), F.lit(True)).alias(f"c{i}"))
    return dict(zip(columns, df.agg(*checks).first(), strict=True))


def exact_whole(c: Column, number: Column) -> Column:
    """The bigint that a number is: from its digits, or from a double that is surely whole."""
    sure = is_whole(number) & (F.abs(number) < F.lit(float(1 << 53)))
    digits = F.when(number.isNotNull(), c.cast("string").try_cast("bigint"))
    return F.coalesce(digits, F.when(sure, number.try_cast("bigint")))


def validate_dates(df: DataFrame, columns: list[str], default: date | None = None) -> DataFrame:
    """Timestamps of text columns; text that does not parse becomes the default (today)."""
    fallback = F.current_date() if default is None else F.lit(default)
    return df.withColumns(
        {
            n: F.coalesce(parse_time(F.col(f"`{n}`")), fallback.cast("timestamp"))
            for n in columns
        }
    )


def clean_email(c: Column, default: str = UNKNOWN_EMAIL) -> Column:
    """The value when it has an @, else the default (also for null)."""
    return F.when(F.coalesce(c.contains("@"), F.lit(False)), c).otherwise(F.lit(default))


def clean_strings(df: DataFrame, columns: list[str], email_default: str = UNKNOWN_EMAIL) -> DataFrame:
    """Trim and collapse white space; a column named ``email`` is repaired instead."""
    return df.withColumns(
        {
            n: clean_email(F.col(f"`{n}`"), email_default)
            if n == "email"
            else collapse_spaces(F.col(f"`{n}`"))
            for n in columns
        }
    )


STEPS = {
    "handle_nulls": lambda df, cols, p: fill_nulls(df, cols, p.get("fill_value", NULL_TEXT)),
    "convert_types": lambda df, cols, p: convert_types(df, cols, p.get("fill_value", 0), p.get("_whole")),
    "validate_dates": lambda df, cols, p: validate_dates(df, cols, _date(p.get("default_date"))),
    "clean_strings": lambda df, cols, p: clean_strings(df, cols, p.get("email_default", UNKNOWN_EMAIL)),
}


def _date(value: str | date | None) -> date | None:
    return date.fromisoformat(value) if isinstance(value, str) else value


STEP_SHAPE = {
    "strategy": str, "description": str, "columns": list, "parameters": dict, "confidence": float,
}


def step_problem(step: dict) -> str | None:
    """What is wrong with a cleaning step, or None."""
    wrong = [key for key, kind in STEP_SHAPE.items() if not isinstance(step.get(key), kind)]
    if wrong:
        return "missing or of another type: " + ", ".join(wrong)
    if not 0 <= step["confidence"] <= 1:
        return "confidence outside [0, 1]"
    if step["strategy"] not in STEPS:
        return f"unknown strategy {step['strategy']}"
    return None


def with_default_steps(plan: list[dict], columns: list[str], today: date | None = None) -> list[dict]:
    """The plan plus the steps every table gets for its email, age and date columns."""
    wanted = (
        ("email", "clean_strings", {"email_default": UNKNOWN_EMAIL}),
        ("age", "convert_types", {"fill_value": 0}),
        ("date", "validate_dates", {"default_date": str(today or date.today())}),
    )
    out = list(plan)
    for column, strategy, parameters in wanted:
        planned = any(s["strategy"] == strategy and column in s["columns"] for s in plan)
        if column in columns and not planned:
            out.append(
                {
                    "strategy": strategy,
                    "description": f"default step for {column}",
                    "columns": [column],
                    "parameters": parameters,
                    "confidence": 0.9,
                }
            )
    return out


def apply_cleaning(
    df: DataFrame, plan: list[dict], defaults: bool = True, today: date | None = None
) -> tuple[DataFrame, list[dict]]:
    """(cleaned frame, steps that were applied). Steps that are malformed, below confidence 0.7 or
    not applicable to the table are left out."""
    steps = [
        step for step in (with_default_steps(plan, df.columns, today) if defaults else plan)
        if not step_problem(step) and step["confidence"] >= MIN_CONFIDENCE and set(step["columns"]) <= set(df.columns)
    ]
    # one aggregate over the source decides for all columns that no earlier step changes
    touched: set[str] = set()
    early: dict[int, list[str]] = {}
    for i, step in enumerate(steps):
        if step["strategy"] == "convert_types":
            early[i] = [n for n in step["columns"] if n not in touched]
        touched |= set(step["columns"])
    try:
        whole = whole_columns(df, sorted({n for names in early.values() for n in names}))
    except AnalysisException:  # the step at fault decides for itself
        whole = {}
    applied = []
    for i, step in enumerate(steps):
        known = {"_whole": {n: whole[n] for n in early[i] if n in whole}} if i in early else {}
        try:
            df = STEPS[step["strategy"]](df, step["columns"], step["parameters"] | known)
            df.schema  # analysis errors belong to this step
        except AnalysisException:  # a job that fails is no step that does not apply
            continue
        applied.append({k: step[k] for k in ("strategy", "columns", "parameters")})
    return df, applied
