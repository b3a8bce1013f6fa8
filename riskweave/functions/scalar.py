"""Scalar expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskweave.config import RiskConfig

MICROS = {"1h": 3_600_000_000, "1D": 86_400_000_000, "7D": 604_800_000_000, "30D": 2_592_000_000_000}


def safe_div(n: Column, d: Column) -> Column:
    """n / d; 0 where that is null, NaN or infinite."""
    q = F.try_divide(n.cast("double"), d.cast("double"))
    return F.when(q.isNull() | F.isnan(q) | (F.abs(q) == float("inf")), 0.0).otherwise(q)


def clean(c: Column) -> Column:
    """A number with null, NaN and infinities as 0."""
    c = c.cast("double")
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), 0.0).otherwise(c)


def steady_sum(c: Column) -> Column:
    """The sum of doubles, the same in whatever order and partitions they come.

    Each is added as a whole number and two times 31 binary digits behind the point, all exactly;
    digits beyond, which only numbers under 0.001 have, are cut off. A group with a number of 2^62
    or more, an infinity or NaN, or with sums beyond such a number, has the plain sum. Nulls are
    left out; the sum of nothing else is null.
    """
    c = c.cast("double")
    whole = F.when(F.abs(c) < 2.0**62, c).cast("long")
    rest = (c - whole.cast("double")) * 2.0**31
    first = rest.cast("long")
    second = ((rest - first.cast("double")) * 2.0**31).cast("long")
    parts = [F.try_sum(x) for x in (whole, first, second)]
    digits = F.lit(2**31 - 1).cast("long")

    def carried(whole: Column, first: Column, second: Column) -> tuple[Column, Column]:
        """The whole number at or below, and the sum."""
        first = first + F.shiftright(second, 31)
        whole = whole + F.shiftright(first, 31)
        behind = first.bitwiseAND(digits) * F.lit(2**31).cast("long") + second.bitwiseAND(digits)
        return whole, whole.cast("double") + behind.cast("double") / 2.0**62

    floor, total = carried(*parts)
    exact = F.when(floor < 0, -carried(*[-x for x in parts])[1]).otherwise(total)  # small negative sums keep their digits
    held = (F.count(whole) == F.count(c)) & parts[0].between(-(2**62), 2**62) & parts[1].isNotNull() & parts[2].isNotNull()
    return F.when(held, exact).otherwise(F.sum(c))


def is_weekend(ts: Column) -> Column:
    return (F.weekday(ts) >= 5).cast("int")


def days_between(later: Column, earlier: Column) -> Column:
    """Days, at least 0, and 0 if one end is missing."""
    return F.coalesce(F.greatest((F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(8.64e10), F.lit(0.0)), F.lit(0.0))


def scaled(c: Column, lo: Column | float, hi: Column | float) -> Column:
    """c between lo and hi as 0 to 1, clipped; NaN counts as null."""
    lo, hi = (x if isinstance(x, Column) else F.lit(float(x)) for x in (lo, hi))
    return F.greatest(F.least((F.when(~F.isnan(c), c) - lo) / (hi - lo), F.lit(1.0)), F.lit(0.0))


def band(score: Column, low: Column | float, high: Column | float) -> Column:
    return F.when(score < low, "low").when(score < high, "medium").otherwise("high")


def row_loss(bands: Column, label: Column, c: RiskConfig) -> Column:
    """Cost of one row's band given its label."""
    fraud = label == 1
    review = F.when(fraud, c.c_review + c.c_fn * (1 - c.catch_rate)).otherwise(c.c_review)
    return F.when((bands == "low") & fraud, c.c_fn).when(bands == "medium", review).when((bands == "high") & ~fraud, c.c_fp).otherwise(0.0)


def logistic(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))
