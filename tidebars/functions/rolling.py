"""Ordered window expressions over bars: one row per (symbol, ts), partitioned by symbol.

A rolling value is NULL until its frame holds n values that aren't. All share one partitioning and order, so Spark plans one
exchange and one sort for any number of them.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark import SparkContext
from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from tidebars.functions.nulls import safe_div, true


@lru_cache(256)
def framed(context: SparkContext | None, first: int | None, last: int) -> WindowSpec:
    """A frame over a symbol's bars, or the whole order without one; specs are made once a context, since each costs calls to the JVM."""
    if first is None:
        return Window.partitionBy("symbol").orderBy("ts")
    return framed(context, None, 0).rowsBetween(first, last)


def bar() -> WindowSpec:
    return framed(SparkContext._active_spark_context, None, 0)


def so_far() -> WindowSpec:
    return framed(SparkContext._active_spark_context, Window.unboundedPreceding, 0)


def last_n(n: int, by: WindowSpec | None = None) -> WindowSpec:
    return framed(SparkContext._active_spark_context, 1 - n, 0) if by is None else by.rowsBetween(1 - n, 0)


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def prev(x: str | Column, k: int = 1) -> Column:
    return F.lag(col(x), k).over(bar())


def change(x: str | Column, k: int = 1) -> Column:
    return col(x) - prev(x, k)


def rolled(agg, x: str | Column, n: int, by: WindowSpec | None = None) -> Column:
    w = last_n(n, by)
    return F.when(F.count(col(x)).over(w) == n, agg(col(x)).over(w))


def mean(x, n: int, by: WindowSpec | None = None) -> Column:
    return rolled(F.avg, x, n, by)


def total(x, n: int) -> Column:
    return rolled(F.sum, x, n)


def deviation(x, n: int, by: WindowSpec | None = None) -> Column:
    return rolled(F.stddev_pop, x, n, by)


def highest(x, n: int) -> Column:
    return rolled(F.max, x, n)


def lowest(x, n: int) -> Column:
    return rolled(F.min, x, n)


def values(x, n: int) -> Column:
    """The last n values as an array, NULL until there are n."""
    w = last_n(n)
    return F.when(F.count(col(x)).over(w) == n, F.collect_list(col(x)).over(w))


def skew(x, n: int) -> Column:
    """Bias-adjusted; 0 for a constant window."""
    g = rolled(F.skewness, x, n)
    flat = rolled(F.max, x, n) == rolled(F.min, x, n)
    return F.when(flat, 0.0).otherwise(g * F.lit((n * (n - 1)) ** 0.5 / (n - 2)))


def kurtosis(x, n: int) -> Column:
    """Bias-adjusted excess; -3 for a constant window."""
    g = rolled(F.kurtosis, x, n)
    flat = rolled(F.max, x, n) == rolled(F.min, x, n)
    return F.when(flat, -3.0).otherwise(((n + 1) * g + 6.0) * F.lit((n - 1) / ((n - 2) * (n - 3))))


def correlation(x, y, n: int) -> Column:
    """Pearson over pairs without NULLs; NULL for a constant window (no division by zero)."""
    w = last_n(n)
    both = F.when(col(x).isNotNull() & col(y).isNotNull(), F.lit(1))
    a, b = F.when(both == 1, col(x)), F.when(both == 1, col(y))
    r = safe_div(F.covar_pop(a, b).over(w), F.stddev_pop(a).over(w) * F.stddev_pop(b).over(w))
    return F.when(F.count(both).over(w) == n, r)


def regression(x, n: int, index: str, back: int = 0) -> Column:
    """Value of the least-squares line through the last n values, `back` rows before the current one; index: a row number."""
    w = last_n(n)
    line = F.regr_intercept(col(x), F.col(index)).over(w) + F.regr_slope(col(x), F.col(index)).over(w) * (F.col(index) - back)
    return F.when(F.count(col(x)).over(w) == n, line)


def percentile(x, n: int) -> Column:
    """Percentage rank of the current value among the last n, ties at their average."""
    rank = lambda a, v: F.size(F.filter(a, lambda y: y < v)) + (F.size(F.filter(a, lambda y: y == v)) + 1) / 2
    return F.when(col(x).isNotNull(), rank(values(x, n), col(x)) / n * 100.0)


def carried(x: Column) -> Column:
    """The last value that isn't NULL."""
    return F.last(x, ignorenulls=True).over(so_far())


def previous(x: Column) -> Column:
    """The last value that isn't NULL, before the current row."""
    return F.last(x, ignorenulls=True).over(framed(SparkContext._active_spark_context, Window.unboundedPreceding, -1))


def bars_since(cond: Column, index: str = "rn") -> Column:
    """0 where cond holds, then 1, 2, ...; NULL before the first time."""
    return F.col(index) - carried(F.when(true(cond), F.col(index)))


def run_length(cond: Column, index: str = "rn") -> Column:
    """Rows since cond last failed: the length of the current run, 0 outside one."""
    since = F.coalesce(carried(F.when(~true(cond), F.col(index))), F.lit(0))
    return F.col(index) - since


def crosses_above(x: Column, level: float | Column) -> Column:
    now = F.lit(level) if isinstance(level, (int, float)) else level
    before = now if isinstance(level, (int, float)) else prev(level)
    return (prev(x) <= before) & (x > now)


def crosses_below(x: Column, level: float | Column) -> Column:
    now = F.lit(level) if isinstance(level, (int, float)) else level
    before = now if isinstance(level, (int, float)) else prev(level)
    return (prev(x) >= before) & (x < now)


def pivot_high(x, left: int = 2, right: int = 2) -> Column:
    """A local maximum, told when `right` later bars have confirmed it; flat tops all count."""
    w = last_n(left + right + 1)
    v = prev(x, right)
    return F.when((F.count(col(x)).over(w) == left + right + 1) & (v == F.max(col(x)).over(w)), v)


def pivot_low(x, left: int = 2, right: int = 2) -> Column:
    w = last_n(left + right + 1)
    v = prev(x, right)
    return F.when((F.count(col(x)).over(w) == left + right + 1) & (v == F.min(col(x)).over(w)), v)
