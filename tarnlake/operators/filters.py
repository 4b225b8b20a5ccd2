"""Row filters."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlake.functions.text import is_blank
from tarnlake.types import is_text


def _like(c: Column, v: Any) -> Column:
    return c.contains(v)


OPERATORS: dict[str, Callable[[Column, Any], Column]] = {
    "=": lambda c, v: c == v,
    "==": lambda c, v: c == v,
    "!=": lambda c, v: c != v,
    "<>": lambda c, v: c != v,
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
    "in": lambda c, v: c.isin(list(v)),
    "between": lambda c, v: c.between(v[0], v[1]),
    "contains": _like,
    "starts_with": lambda c, v: c.startswith(v),
    "ends_with": lambda c, v: c.endswith(v),
    "is_null": lambda c, _: c.isNull(),
    "is_not_null": lambda c, _: c.isNotNull(),
}


def condition(spec: dict[str, Any]) -> Column:
    """Column of a {column, operator, value} filter; an unknown operator raises."""
    name = str(spec.get("operator", "=")).lower().replace(" ", "_")
    if name not in OPERATORS:
        raise ValueError(f"unknown operator {spec.get('operator')!r}")
    return OPERATORS[name](F.col(spec["column"]), spec.get("value"))


def where_all(df: DataFrame, specs: list[dict[str, Any]]) -> DataFrame:
    """Rows that pass every {column, operator, value} filter."""
    return df.filter(reduce(lambda a, b: a & b, map(condition, specs), F.lit(True)))


def apply_filter(
    df: DataFrame, spec: dict[str, Any], limit: int | None = None, order: list[str] | None = None
) -> DataFrame:
    """One structured filter, with an optional order and limit."""
    out = df.filter(condition(spec))
    if order:
        out = out.orderBy(*order)
    return out if limit is None else out.limit(limit)


def drop_empty_rows(df: DataFrame) -> DataFrame:
    """Drop rows that are null in every column."""
    return df.dropna(how="all")


def drop_blank_rows(df: DataFrame) -> DataFrame:
    """Drop rows whose text columns are all blank (a null is not blank)."""
    texts = [f.name for f in df.schema.fields if is_text(f.dataType)]
    if not texts:
        return df
    return df.filter(~reduce(lambda a, b: a & b, [is_blank(F.col(f"`{n}`")) for n in texts]))


def search(df: DataFrame, term: str, columns: list[str]) -> DataFrame:
    """Rows with the term, in any letter case, in one of the columns; no term keeps all rows."""
    if not term:
        return df
    needle = F.lower(F.lit(term))
    hits = [F.coalesce(F.lower(F.col(n)).contains(needle), F.lit(False)) for n in columns]
    return df.filter(reduce(lambda a, b: a | b, hits))


def newest_with_prefix(
    df: DataFrame, column: str, prefix: str, newest: str, tie: str, limit: int = 10
) -> DataFrame:
    """Newest rows whose text starts with a prefix."""
    return (
        df.filter(F.col(column).startswith(prefix))
        .orderBy(F.col(newest).desc_nulls_last(), F.col(tie))
        .limit(limit)
    )
