"""Time series with gap filling, growth, calendar patterns.

Everything but ``weekday_counts`` reads the transaction metrics table (one row
per transaction), so transactions are counted without a distinct and the fact
is not scanned. After a category filter the caller passes
``facts.transaction_metrics`` of the filtered fact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tillroll.functions.calendar import DAY_ORDER, month_short_name, period_label, period_spine
from tillroll.functions.numeric import pct_change
from tillroll.operators.baskets import add_calendar

METRICS = ("units", "transactions", "customers")


def _metric(name: str):
    if name in ("units", "quantity"):
        return F.sum("total_quantity")
    if name in ("transactions", "transaction_id"):
        return F.count(F.lit(1))
    if name in ("customers", "customer_id"):
        return F.count_distinct("customer_id")
    raise ValueError(f"unknown metric {name!r}")


def _spine(per_period: DataFrame, freq: str) -> DataFrame:
    """Every period label between the first and last populated period.

    Bounds come from the (small) per-period table; the spine size is the
    number of periods in the span, independent of the data volume.
    """
    return per_period.agg(F.min("period").alias("lo"), F.max("period").alias("hi")) \
                     .select(F.explode(period_spine(F.col("lo"), F.col("hi"), freq)).alias("period"))


def _fill(per_period: DataFrame, freq: str, value_cols: list[str]) -> DataFrame:
    return (_spine(per_period, freq).join(per_period, "period", "left")
            .select("period", *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
                                for c in value_cols]))


def time_series(tx: DataFrame, metric: str = "units", freq: str = "D") -> DataFrame:
    """One value per D/W/M period between the first and last date, gaps as 0.

    W periods end on Sunday (label = that Sunday), M periods are labelled by
    the month's last day.
    """
    per = (tx.select(period_label(F.col("date"), freq).alias("period"), "total_quantity", "customer_id")
             .groupBy("period").agg(_metric(metric).alias("value")))
    return _fill(per, freq, ["value"])


def _previous_label(period, freq: str):
    f = freq.upper()
    if f == "D":
        return F.date_sub(period, 1)
    if f == "W":
        return F.date_sub(period, 7)
    return F.last_day(F.add_months(period, -1))


def growth(tx: DataFrame, freq: str = "M") -> DataFrame:
    """Units, transactions and customers per period and their % change.

    The previous period is found by an equi-join on its label (gap-free spine),
    not by a window over all periods, so nothing funnels into one partition.
    """
    per = (tx.select(period_label(F.col("date"), freq).alias("period"), "total_quantity", "customer_id")
             .groupBy("period").agg(_metric("units").alias("total_units"),
                                    _metric("transactions").alias("transactions"),
                                    _metric("customers").alias("customers")))
    cols = ["total_units", "transactions", "customers"]
    filled = _fill(per, freq, cols)
    prev = filled.select(F.col("period").alias("_prev_period"),
                         *[F.col(c).alias(f"_prev_{c}") for c in cols])
    j = filled.join(prev, _previous_label(filled["period"], freq) == prev["_prev_period"], "left")
    return j.select(
        "period", *cols,
        pct_change("total_units", "_prev_total_units").alias("units_growth"),
        pct_change("transactions", "_prev_transactions").alias("transactions_growth"),
        pct_change("customers", "_prev_customers").alias("customers_growth"),
    ).orderBy("period")


def _pattern(tx: DataFrame, key: str) -> DataFrame:
    return add_calendar(tx.select("date", "total_quantity")).groupBy(key).agg(
        _metric("units").alias("total_units"), _metric("transactions").alias("transactions"))


def patterns_by_day_of_week(tx: DataFrame) -> DataFrame:
    return _pattern(tx, "day_of_week").orderBy("day_of_week")


def patterns_by_month(tx: DataFrame) -> DataFrame:
    return _pattern(tx, "month").select("month", month_short_name("month").alias("month_name"),
                                          "total_units", "transactions").orderBy("month")


def patterns_by_day_name(tx: DataFrame) -> DataFrame:
    order = F.array_position(F.array(*[F.lit(d) for d in DAY_ORDER]), F.col("day_name"))
    return _pattern(tx, "day_name").orderBy(order)


def patterns_weekend(tx: DataFrame) -> DataFrame:
    return _pattern(tx, "is_weekend").orderBy("is_weekend")


def temporal_patterns(tx: DataFrame) -> dict[str, DataFrame]:
    return {"by_day_of_week": patterns_by_day_of_week(tx),
            "by_month": patterns_by_month(tx),
            "by_weekday_name": patterns_by_day_name(tx),
            "weekend_vs_weekday": patterns_weekend(tx)}


def weekday_counts(fact: DataFrame) -> DataFrame:
    """Row count per weekday (fact rows, not distinct transactions)."""
    return (fact.groupBy("day_name", "day_of_week").agg(F.count(F.lit(1)).alias("count"))
                .orderBy("day_of_week"))
