"""Column expressions with the null and edge semantics that the panel operators need."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """``c``, or null where it is NaN or infinite. (O-33)"""
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def guarded_ratio(a: Column, b: Column) -> Column:
    """a / b where both are finite and b is positive, else null. (O-34)"""
    a, b = finite(a), finite(b)
    return F.when(b > 0, a / b)


def clip(c: Column, low: float | None = None, high: float | None = None) -> Column:
    """``c`` within bounds; null stays null. (O-35)"""
    out = c
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return F.when(c.isNotNull(), out)


def next_business_day(d: Column) -> Column:
    """The first weekday after ``d``. (O-27)"""
    return F.date_add(d, F.when(F.dayofweek(d) == 6, 3).when(F.dayofweek(d) == 7, 2).otherwise(1))


def missing_share(*columns: Column) -> Column:
    """The share of null columns. (O-59)"""
    return reduce(lambda a, b: a + b, [c.isNull().cast("int") for c in columns]) / F.lit(float(len(columns)))


def unbiased_skew(c: Column, over: WindowSpec | None = None) -> Column:
    """Sample skewness with the bias correction; null below three values or without spread. (O-75)"""
    n, s, k = F.count(c), F.stddev_pop(c), F.skewness(c)
    if over is not None:
        n, s, k = n.over(over), s.over(over), k.over(over)
    return F.when((n > 2) & (s > 0), k * F.sqrt(n * (n - 1)) / (n - 2))


def prior(window: WindowSpec, n: int) -> WindowSpec:
    """The n rows before the current one. (O-81)"""
    return window.rowsBetween(-n, -1)


def full(value: Column, window: WindowSpec, n: int, of: Column) -> Column:
    """``value`` over ``window`` where it has n non-null values of ``of``."""
    return F.when(F.count(of).over(window) == n, value.over(window))


def average_rank(c: Column, *group: str) -> Column:
    """Rank from 1, ascending, ties averaged; null for null. (O-94, O-95)

    Ties are counted in the rank's own window, so all ranks of a group share one shuffle.
    """
    w = Window.partitionBy(*group).orderBy(c.asc_nulls_last())
    ties = F.count(c).over(w.rangeBetween(Window.currentRow, Window.currentRow))
    return F.when(c.isNotNull(), F.rank().over(w) + (ties - 1) / F.lit(2.0))


def percentile_rank(c: Column, *group: str) -> Column:
    """Average rank over the number of values. (O-94)"""
    return average_rank(c, *group) / F.count(c).over(Window.partitionBy(*group))


def signed_rank(c: Column, direction: int, *group: str) -> Column:
    """Percentile rank turned so that more is better; a missing value is neutral. (O-94)"""
    return F.coalesce((percentile_rank(c, *group) - 0.5) * direction + 0.5, F.lit(0.5))


def quantile_bucket(c: Column, buckets: int, *group: str, tie: str) -> Column:
    """Bucket 1 .. ``buckets`` of the first-come rank (ties by column ``tie``), cut as equal-frequency quantiles. (O-96)"""
    w = Window.partitionBy(*group)
    r, n = F.row_number().over(w.orderBy(c, tie)), F.count("*").over(w)
    return F.when(n == 1, 1).otherwise(F.greatest(F.lit(1), F.ceil((r - 1) * buckets / (n - 1)))).cast("int")


def normalize_ticker(c: Column) -> Column:
    """Trimmed, upper case, dots for dashes; null if nothing is left. (O-110)"""
    t = F.regexp_replace(F.upper(F.trim(c)), "-", ".")
    return F.when(t != "", t)


def normalize_cik(c: Column) -> Column:
    """The digits of an issuer number, padded to ten; null for anything else. (O-110)"""
    digits = F.regexp_replace(F.trim(c), r"\.0$", "")
    return F.when(digits.rlike(r"^\d{1,10}$"), F.lpad(digits, 10, "0"))


def find_column(names: list[str], wanted: str) -> str | None:
    """The first of ``names`` that equals ``wanted`` but for case and what is no letter or digit. (O-37)"""
    plain = lambda x: "".join(c for c in x.lower() if c.isalnum())
    return next((n for n in names if plain(n) == plain(wanted)), None)
