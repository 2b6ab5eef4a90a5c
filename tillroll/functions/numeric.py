"""Null-safe arithmetic under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(a, b) -> Column:
    """a / b, null when b is 0 or null (plain / raises under ANSI)."""
    a, b = _c(a), _c(b)
    return F.when(b != 0, a.cast("double") / b)


def pct_change(cur, prev) -> Column:
    """Percent change as pandas computes it: first row null, x/0 -> +/-Infinity, 0/0 -> null."""
    cur, prev = _c(cur).cast("double"), _c(prev).cast("double")
    return (F.when(prev.isNull() | cur.isNull(), F.lit(None).cast("double"))
            .when((prev == 0) & (cur == 0), F.lit(None).cast("double"))
            .when((prev == 0) & (cur > 0), F.lit(float("inf")))
            .when(prev == 0, F.lit(float("-inf")))
            .otherwise((cur - prev) / prev * 100.0))


def round_half_even(c, scale: int = 2) -> Column:
    """Half-to-even rounding, as pandas/NumPy round."""
    return F.bround(_c(c), scale)


def r6(c) -> Column:
    """Six-decimal rounding used when comparing floating results."""
    return F.round(_c(c).cast("double"), 6)


def distinct_count(c, exact: bool = True, rsd: float = 0.01) -> Column:
    """count(DISTINCT c); with exact=False a HyperLogLog++ estimate (relative
    standard deviation ``rsd``) whose buffer is fixed-size per group, for very
    large groups where exact counting shuffles every distinct value."""
    c = _c(c)
    return F.count_distinct(c) if exact else F.approx_count_distinct(c, rsd)
