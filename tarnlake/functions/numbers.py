"""Numeric coercion and ratios that never raise under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnlake.functions.text import null_if_in, strip

# Texts that stand for a missing number.
MISSING_WORDS = ["unknown", "invalid", "null", "nan", ""]


def to_number(c: Column, missing: list[str] = MISSING_WORDS) -> Column:
    """Double of a text; listed words, unparseable text and NaN become null."""
    text = strip(null_if_in(c.cast("string"), missing))
    number = text.try_cast("double")
    # Java also reads 1d and 2.5f as numbers
    return F.when(~F.isnan(number) & ~text.rlike("[0-9.][dDfF]$"), number)


def is_whole(c: Column) -> Column:
    """True when a number has no fraction."""
    return (c % F.lit(1)) == F.lit(0)


def ratio(a: Column, b: Column) -> Column:
    """a / b as double; null when b is zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def variation(c: Column) -> Column:
    """Sample standard deviation over mean (aggregate); null when the mean is zero."""
    return ratio(F.stddev_samp(c), F.avg(c))


def clamp01(c: Column) -> Column:
    """Value limited to [0, 1]; a null stays null."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)))


def no_nan(c: Column) -> Column:
    """NaN as null."""
    return F.when(~F.isnan(c), c)
