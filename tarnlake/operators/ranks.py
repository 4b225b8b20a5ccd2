"""Exact order statistics of numeric columns by narrowing value ranges.

Each pass counts the values of the current ranges in buckets: one aggregate over the table, at most
``BUCKETS`` rows per wanted rank to the driver. The bucket that holds the rank becomes the next range,
with its smallest and largest value as ends, and only values in open ranges are read on. While the ends of a
range differ by more than a factor of eight, buckets are even in the logarithm (by sign, zero in the middle), else
in the value: one pass gets to a factor of about four, which is 2^54 doubles, and each further one divides these by
2^11. So all values a double can have, denormal and infinite ones too, are found in at most seven passes after
the ends are known. Values are compared as doubles.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnlake.names import quoted
from tarnlake.operators.keys import present

BUCKETS = 1 << 11
#: ends that differ by this factor or less are divided evenly
NEAR = 8.0


@dataclass
class Range:
    """Values from ``low`` to ``high`` hold the rank; ``before`` values are smaller than ``low``."""

    column: str
    rank: int
    low: float
    high: float
    before: int
    inside: int


Ends = tuple[int, float | None, float | None]


def _value(df: DataFrame, columns: list[str]) -> dict[str, str]:
    types = {f.name: f.dataType for f in df.schema.fields}
    return {n: f"CAST({present(n, types[n])} AS DOUBLE)" for n in columns}


def column_ends(df: DataFrame, columns: list[str]) -> dict[str, Ends]:
    """(number of values, smallest, largest) of each column, nulls and NaN left out."""
    value = _value(df, columns)
    facts = df.selectExpr(*[f"{fn}({value[n]})" for n in columns for fn in ("count", "min", "max")]).first()
    return {n: tuple(facts[3 * i : 3 * i + 3]) for i, n in enumerate(columns)}


def values_at(df: DataFrame, wanted: dict[str, list[int]], ends: dict[str, Ends]) -> list[Range]:
    """For each column and rank (from 0) the range that is one value; ranks beyond the end are
    left out."""
    value = _value(df, list(wanted))
    ranges = [
        Range(n, rank, ends[n][1], ends[n][2], 0, ends[n][0])
        for n, ranks in wanted.items()
        for rank in ranks
        if 0 <= rank < ends[n][0]
    ]
    _settle_infinities(df, value, ranges)
    while open_ranges := [r for r in ranges if r.low != r.high]:
        # ranks that still share a range are counted once
        spans = list({(r.column, r.low, r.high) for r in open_ranges})
        counted = _histograms(df, value, spans)
        for r in open_ranges:
            below = r.before
            for n, low, high in counted[spans.index((r.column, r.low, r.high))]:
                if r.rank < below + n:
                    r.low, r.high, r.before, r.inside = low, high, below, n
                    break
                below += n
    return ranges


def _settle_infinities(df: DataFrame, value: dict[str, str], ranges: list[Range]) -> None:
    """Ranks among infinite values are settled at once, all others start from the finite ends: an
    infinite range could not be split."""
    columns = sorted({r.column for r in ranges if math.isinf(r.low) or math.isinf(r.high)})
    if not columns:
        return
    limit = "CAST('Infinity' AS DOUBLE)"
    facts = df.selectExpr(
        *[
            e
            for n in columns
            for e in (
                f"count_if({value[n]} = -{limit})",
                f"count_if({value[n]} = {limit})",
                f"min(CASE WHEN abs({value[n]}) < {limit} THEN {value[n]} END)",
                f"max(CASE WHEN abs({value[n]}) < {limit} THEN {value[n]} END)",
            )
        ]
    ).first()
    for r in ranges:
        if r.column in columns:
            low, high, least, most = facts[4 * columns.index(r.column) : 4 * columns.index(r.column) + 4]
            whole = r.inside
            if r.rank < low:
                r.low = r.high = -math.inf
                r.inside = low
            elif r.rank >= whole - high:
                r.low = r.high = math.inf
                r.before, r.inside = whole - high, high
            else:
                r.low, r.high, r.before, r.inside = least, most, low, whole - low - high


def _double(x: float) -> str:
    """The very double, by its 17 digits."""
    return f"CAST('{x!r}' AS DOUBLE)"


def _bucket(v: str, low: float, high: float) -> str:
    """The bucket of a value between two finite ends, in the order of the values."""
    a, b = _double(low), _double(high)
    if (low > 0 or high < 0) and max(abs(low), abs(high)) <= NEAR * min(abs(low), abs(high)):
        # halves, where the width would overflow
        half = "" if math.isfinite(high - low) else " / 2"
    else:
        # the logarithm of the smallest double is -1074
        v, a, b = (f"CASE WHEN {x} = 0 THEN 0D ELSE signum({x}) * (log2(abs({x})) + 1076) END" for x in (v, a, b))
        v, a, b, half = f"({v})", f"({a})", f"({b})", ""
    return f"CAST(least(floor(({v}{half} - {a}{half}) / ({b}{half} - {a}{half}) * {BUCKETS}), {BUCKETS - 1}) AS INT)"


def _inside(column: str, data_type: T.DataType, low: float, high: float) -> str:
    """Whether the column may lie between two doubles, in a form that scans can use."""
    c = quoted(column)
    if isinstance(data_type, T.IntegralType):
        # whole numbers that become these doubles lie less than 2048 from them
        least, most = max(int(low) - 2048, -(1 << 63)), min(int(high) + 2048, (1 << 63) - 1)
        return f"({c} >= {_whole(least)} AND {c} <= {_whole(most)})"
    if isinstance(data_type, T.DoubleType):
        return f"({c} >= {_double(low)} AND {c} <= {_double(high)})"
    return f"(CAST({c} AS DOUBLE) >= {_double(low)} AND CAST({c} AS DOUBLE) <= {_double(high)})"


def _whole(n: int) -> str:
    return f"CAST('{n}' AS BIGINT)"


def open_values(df: DataFrame, spans: list[tuple[str, float, float]]) -> DataFrame:
    """The rows that a pass over some ranges reads."""
    types = {f.name: f.dataType for f in df.schema.fields}
    return df.filter(" OR ".join(_inside(n, types[n], low, high) for n, low, high in spans))


def _histograms(df, value, spans) -> list[list[tuple]]:
    """(count, smallest, largest value) of the filled buckets of each span, in order."""
    cells = []
    for i, (column, low, high) in enumerate(spans):
        v = value[column]
        cells.append(
            f"CASE WHEN {v} BETWEEN {_double(low)} AND {_double(high)} "
            f"THEN named_struct('span', {i}, 'bucket', {_bucket(v, low, high)}, 'v', {v}) END"
        )
    rows = (
        open_values(df, spans)
        .selectExpr(f"inline(array_compact(array({', '.join(cells)})))")
        .groupBy("span", "bucket")
        .agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        .collect()
    )
    out: list[list[tuple]] = [[] for _ in spans]
    for r in sorted(rows, key=lambda r: (r["span"], r["bucket"])):
        out[r["span"]].append((r["n"], r["low"], r["high"]))
    return out


def exact_quantiles(
    df: DataFrame,
    columns: list[str],
    probabilities: list[float],
    ends: dict[str, Ends] | None = None,
) -> dict[str, list[float | None]]:
    """Quantiles with linear interpolation between neighbouring values; None without values."""
    ends = ends or column_ends(df, columns)
    last = {n: ends[n][0] - 1 for n in columns}
    places = {n: [p * last[n] for p in probabilities] for n in columns if ends[n][0]}
    wanted = {
        n: sorted({k for at in ats for k in (int(at), min(int(at) + 1, last[n]))})
        for n, ats in places.items()
    }
    found = {(r.column, r.rank): r.low for r in values_at(df, wanted, ends)}
    out: dict[str, list[float | None]] = {n: [None] * len(probabilities) for n in columns}
    for n, ats in places.items():
        for j, at in enumerate(ats):
            low, high = found[n, int(at)], found[n, min(int(at) + 1, last[n])]
            out[n][j] = low if low == high else low + (high - low) * (at - int(at))
    return out
