"""Null-safe arithmetic: missing values are NULL, never NaN, and a comparison with one is false."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_div(a: Column, b: Column) -> Column:
    """NULL where the divisor is zero."""
    return F.try_divide(a, b)


def pct(a: Column, b: Column) -> Column:
    return safe_div(a, b) * 100.0


def true(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False))


def flag(cond: Column) -> Column:
    """1 or 0; 0 where the condition is unknown."""
    return true(cond).cast("int")


def zone(x: Column, above: float | Column, below: float | Column) -> Column:
    """+1 above, -1 below, else 0."""
    return flag(x > above) - flag(x < below)


def sign0(x: Column) -> Column:
    """Sign, 0 where unknown."""
    return F.coalesce(F.signum(x), F.lit(0.0))


def signed_log1p(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))
