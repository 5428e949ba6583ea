"""Coercions of dirty numbers and addresses. All are JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_int(c: Column) -> Column:
    """Integer; what is not one becomes 0 (a numeric column is truncated toward zero)."""
    return F.coalesce(c.try_cast("int"), F.lit(0))


def safe_number(c: Column) -> Column:
    """A string column parsed as an integer, else 0; a numeric column unchanged, null 0."""
    number = F.when(F.typeof(c) == "string", c.try_cast("int").cast("double")).otherwise(c.try_cast("double"))
    return F.coalesce(number, F.lit(0.0))


def safe_float(c: Column) -> Column:
    """Double; what is not one becomes 0."""
    return F.coalesce(c.try_cast("double"), F.lit(0.0))


def ip_or_unknown(c: Column) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit("unknown"))


def cents(c: Column) -> Column:
    """The double rounded to two decimals by its exact binary value, ties to even (2.675 is less than it looks: 2.67; 0.125: 0.12).

    ``c * 100`` is itself rounded; only where it falls on a half does its error (Dekker's product) decide.
    """
    scaled = c * F.lit(100.0)
    spread = c * F.lit(134217729.0)
    high = spread - (spread - c)
    error = (high * F.lit(100.0) - scaled) + (c - high) * F.lit(100.0)
    half = F.abs(scaled - F.floor(scaled) - F.lit(0.5)) == 0
    whole = F.when(half & (error > 0), F.ceil(scaled).cast("double")).when(half & (error < 0), F.floor(scaled).cast("double")).otherwise(F.rint(scaled))
    return whole / F.lit(100.0)


def rounded(c: Column, digits: int) -> Column:
    """The double rounded as SQL engines do it in doubles: scaled, then half away from zero (2.03725 times 10,000 falls short of a half)."""
    scaled = F.abs(c) * F.lit(10.0**digits)
    whole = F.floor(scaled).cast("double")
    return F.signum(c) * (whole + F.when(scaled - whole >= 0.5, 1.0).otherwise(0.0)) / F.lit(10.0**digits)


def capped_ratio(x: Column, most: float) -> Column:
    """x / most, at most 1; 0 where most is 0."""
    return F.least(x / F.lit(float(most)), F.lit(1.0)) if most else F.lit(0.0)
