"""Basket expansion, category enrichment, calendar features and dashboard filters."""

from __future__ import annotations

import datetime as _dt
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tillroll.functions.calendar import calendar_columns
from tillroll.schemas import FACT_KEYS

# Sentinel meaning "no filter" in the dashboard selectors (fixed value).
ALL = "Todas"


def _tokens(products: Column) -> Column:
    """The product ids of a basket string in order, after a null for each token
    that is not an integer. Never empty: '' and null give one null."""
    text = F.coalesce(products, F.lit(""))
    # most baskets hold blanks only, and those are cut without a regular expression
    # (between two blanks stands an empty token, which is no integer)
    other = reduce(lambda a, b: a | b, [F.contains(text, F.lit(c)) for c in "\t\n\x0b\f\r"])
    tokens = F.when(other, F.split(text, r"\s+")).otherwise(F.split(text, " "))
    # cast and sorted by element in compiled code: no lambda, no comparator
    return F.sort_array(tokens.try_cast("array<bigint>"))


def parse_product_ids(products: Column) -> Column:
    """Sorted array of the integer product ids of a basket string.

    Whitespace-separated tokens; tokens that are not integers are skipped, so
    '', 'nan', null and 'a b' give an empty array.
    """
    return F.array_compact(_tokens(products))


def expand_baskets(raw: DataFrame, products: str = "products") -> DataFrame:
    """One row per (basket row, distinct product) with the repeat count as quantity.

    ``raw`` carries one basket per row plus its key columns (everything but
    ``products`` is copied onto each output row). Repeats are counted inside
    the row as run lengths of the sorted id array, so no shuffle is needed.
    Tokens that are no ids are a run of nulls, left out at the end.
    Arrays are only ever arguments of zip_with, never referenced in
    a lambda body, which keeps the work O(n log n) per basket.
    """
    keys = [c for c in raw.columns if c != products]
    s = raw.select(*keys, _tokens(F.col(products)).alias("_s"))
    prev = F.concat(F.array(F.lit(None).cast("bigint")), F.slice("_s", 1, F.size("_s") - 1))
    s = s.select(*keys, "_s", F.zip_with("_s", prev, lambda x, p: ~x.eqNullSafe(p)).alias("_f"))
    idx = F.sequence(F.lit(0), F.size("_s") - 1)
    starts = F.array_remove(F.zip_with("_f", idx, lambda b, i: F.when(b | (i == 0), i).otherwise(-1)), -1)
    s = s.select(*keys, F.array_distinct("_s").alias("_v"), starts.alias("_st"), F.size("_s").alias("_n"))
    ends = F.concat(F.slice("_st", 2, F.size("_st")), F.array("_n"))
    counts = F.zip_with(ends, "_st", lambda e, b: (e - b).cast("bigint"))
    items = F.zip_with("_v", counts, lambda v, c: F.struct(v.alias("product_id"), c.alias("quantity")))
    # the outer form: for the inner one the optimizer would add a filter on the items'
    # size and push it down, so that all of the above is evaluated twice
    return s.select(*keys, F.inline_outer(items)).filter(F.col("product_id").isNotNull())


def transaction_ids(raw: DataFrame, row_no: str = "row_no", batch: str | None = None) -> Column:
    """'<store>_<customer>_<row>' id of a raw basket row (optionally tagged by batch)."""
    parts = [F.col("store_id").cast("string"), F.col("customer_id").cast("string")]
    if batch:
        parts.append(F.lit(batch))
    parts.append(F.col(row_no).cast("string"))
    return F.concat_ws("_", *parts)


def enrich(fact: DataFrame, product_category: DataFrame, categories: DataFrame,
           dedupe: bool = False) -> DataFrame:
    """Left join product -> category id -> category name.

    A product mapped to several categories multiplies its rows, as in the
    reference; ``dedupe=True`` keeps one mapping per product first (the last
    read when the relation has a ``pos`` column, else the smallest id). The planner broadcasts a catalogue only when its measured size is
    under the broadcast threshold, otherwise both joins stay sort-merge (AQE
    splits skewed product partitions).
    """
    if dedupe and "pos" in product_category.columns:
        from tillroll.operators.catalog import dedupe_keep_last
        pc = dedupe_keep_last(product_category.select("product_id", "category_id", "pos"), "product_id", "pos")
    elif dedupe:
        pc = product_category.groupBy("product_id").agg(F.min("category_id").alias("category_id"))
    else:
        pc = product_category.select("product_id", "category_id")
    cats = categories.select("category_id", "category_name")
    out = fact.join(pc, "product_id", "left").join(cats, "category_id", "left")
    cols = [c for c in fact.columns] + ["category_id", "category_name"]
    return out.select(*cols)


def missing_category_report(fact: DataFrame) -> DataFrame:
    return fact.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(F.col("category_id").isNull()).alias("missing_rows"),
    ).select("total_rows", "missing_rows",
             F.when(F.col("total_rows") > 0,
                    F.col("missing_rows") / F.col("total_rows") * 100.0).alias("missing_pct"))


def add_calendar(df: DataFrame, date_col: str = "date") -> DataFrame:
    return df.select("*", *calendar_columns(date_col))


def build_fact(lines: DataFrame, product_category: DataFrame, categories: DataFrame) -> DataFrame:
    """Expanded basket lines -> the enriched fact table with calendar columns."""
    return add_calendar(enrich(lines.select(*FACT_KEYS), product_category, categories))


def _as_date(v):
    if v is None or isinstance(v, _dt.date):
        return v
    return _dt.date.fromisoformat(str(v)[:10])


def apply_filters(fact: DataFrame, date_range=None, store=ALL, category=ALL) -> DataFrame:
    """Dashboard filters: inclusive date range (both ends needed), store, category.

    When the fact carries year/month partition columns, the date range is also
    stated on them so the scan prunes whole partitions.
    """
    out = fact
    if date_range is not None and len(date_range) == 2 and None not in date_range:
        lo, hi = _as_date(date_range[0]), _as_date(date_range[1])
        out = out.filter(F.col("date").between(F.lit(lo), F.lit(hi)))
        if "year" in fact.columns and "month" in fact.columns:
            ym = F.col("year") * 100 + F.col("month")
            out = out.filter(ym.between(lo.year * 100 + lo.month, hi.year * 100 + hi.month))
    if store is not None and store != ALL:
        out = out.filter(F.col("store_id") == int(store))
    if category is not None and category != ALL:
        out = out.filter(F.col("category_name") == category)
    return out


def filter_options(fact: DataFrame) -> DataFrame:
    """Selector contents: date bounds, sorted stores, sorted non-null categories."""
    return fact.agg(
        F.min("date").alias("min_date"),
        F.max("date").alias("max_date"),
        F.array_sort(F.collect_set("store_id")).alias("stores"),
        F.array_sort(F.collect_set("category_name")).alias("categories"),
    )
