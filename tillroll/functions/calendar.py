"""Calendar columns, period labels and gap-free period spines."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values that must equal the reference output.
# Month short names shown in the monthly pattern (Spanish):
MONTH_SHORT_NAMES = ["Ene", "Feb", "Mar", "Abr", "May", "Jun",
                     "Jul", "Ago", "Sep", "Oct", "Nov", "Dic"]
# Weekday display order, Monday first:
DAY_ORDER = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def calendar_columns(date_col="date") -> list[Column]:
    """year, month, day, Monday=0 weekday, English day name, ISO week, weekend flag, quarter."""
    d = _c(date_col)
    dow = F.weekday(d)
    return [
        F.year(d).alias("year"),
        F.month(d).alias("month"),
        F.dayofmonth(d).alias("day"),
        dow.alias("day_of_week"),
        F.date_format(d, "EEEE").alias("day_name"),
        F.weekofyear(d).alias("week_of_year"),
        F.when(dow >= 5, 1).otherwise(0).alias("is_weekend"),
        F.quarter(d).alias("quarter"),
    ]


def month_short_name(month_col) -> Column:
    return F.element_at(F.array(*[F.lit(m) for m in MONTH_SHORT_NAMES]), _c(month_col))


def period_label(date_col, freq: str) -> Column:
    """Label of the period holding a date.

    D: the date; W: the Sunday that ends its Monday-Sunday week; M: the month end.
    """
    d = _c(date_col)
    f = freq.upper()
    if f == "D":
        return d
    if f == "W":
        return F.next_day(F.date_sub(d, 1), "SUN")
    if f == "M":
        return F.last_day(d)
    raise ValueError(f"unknown period {freq!r}; use D, W or M")


def period_spine(first_label: Column, last_label: Column, freq: str) -> Column:
    """Array of every period label between two labels, inclusive."""
    f = freq.upper()
    if f == "D":
        return F.sequence(first_label, last_label, F.expr("INTERVAL 1 DAY"))
    if f == "W":
        return F.sequence(first_label, last_label, F.expr("INTERVAL 7 DAY"))
    if f == "M":
        starts = F.sequence(F.trunc(first_label, "MM"), F.trunc(last_label, "MM"),
                            F.expr("INTERVAL 1 MONTH"))
        return F.transform(starts, lambda s: F.last_day(s))
    raise ValueError(f"unknown period {freq!r}; use D, W or M")
