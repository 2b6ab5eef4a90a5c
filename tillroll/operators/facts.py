"""Per-transaction, per-customer and per-product metric tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tillroll.functions.numeric import distinct_count, safe_div


def _joined(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Both sides' columns by ``key``, of which null is a value like any other."""
    right = right.withColumnRenamed(key, "_key")
    return left.join(right, left[key].eqNullSafe(right["_key"]), "left").drop("_key")


def transaction_metrics(fact: DataFrame) -> DataFrame:
    """Per transaction its date, store, customer, distinct products, units and
    distinct categories. A basket's distinct values are gathered in a set, which is
    as small as the basket, so each row goes through one aggregation."""
    # date/store/customer are constant inside a transaction: min is the
    # deterministic stand-in for "first"
    return fact.groupBy("transaction_id").agg(
        F.min("date").alias("date"),
        F.min("store_id").alias("store_id"),
        F.min("customer_id").alias("customer_id"),
        F.size(F.collect_set("product_id")).cast("long").alias("basket_size"),
        F.sum("quantity").alias("total_quantity"),
        F.size(F.collect_set("category_id")).cast("long").alias("category_diversity"),
    )


def customer_metrics(fact: DataFrame, exact: bool = True) -> DataFrame:
    """RFM-style customer table.

    preferred_store is the most frequent store over the customer's product rows,
    ties to the lowest id; recency counts days back from the latest date in the
    data (a scalar subquery, no join).
    """
    return _customer_ratios(fact.groupBy("customer_id").agg(
        distinct_count("transaction_id", exact).alias("frequency"),
        F.max("date").alias("last_purchase_date"),
        F.sum("quantity").alias("total_quantity"),
        distinct_count("product_id", exact).alias("unique_products"),
        distinct_count("category_id", exact).alias("unique_categories"),
        F.mode("store_id", deterministic=True).alias("preferred_store"),
    ), fact)


def _customer_ratios(totals: DataFrame, dated: DataFrame) -> DataFrame:
    reference_date = dated.select(F.max("date")).scalar()
    return totals.select(
        "customer_id", "frequency", "last_purchase_date", "total_quantity",
        "unique_products", "unique_categories", "preferred_store",
        F.datediff(reference_date, F.col("last_purchase_date")).alias("recency"),
        safe_div("total_quantity", "frequency").alias("avg_basket_size"),
        safe_div("unique_categories", "frequency").alias("category_diversity_score"),
    )


def customer_visits(fact: DataFrame) -> DataFrame:
    """Rows and units per customer, store and category: what the customer tables
    need of the fact. Rows of appended batches add up."""
    return fact.groupBy("customer_id", "store_id", "category_id", "category_name").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("quantity").alias("quantity"))


def customer_totals(fact: DataFrame) -> DataFrame:
    """Transactions, units and last date per customer; batches with their own
    transactions add up. Transactions are counted as groups, not in one set."""
    per = fact.groupBy("customer_id", "transaction_id").agg(F.sum("quantity").alias("quantity"), F.max("date").alias("date"))
    return per.groupBy("customer_id").agg(F.count("transaction_id").alias("transactions"), F.sum("quantity").alias("total_quantity"),
                                          F.max("date").alias("last_date"))


def category_totals(fact: DataFrame) -> DataFrame:
    """Units, transactions and rows per category name; batches with their own
    transactions add up."""
    per = fact.groupBy("category_name", "transaction_id").agg(F.sum("quantity").alias("quantity"), F.count(F.lit(1)).alias("lines"))
    return per.groupBy("category_name").agg(F.sum("quantity").alias("total_units"), F.count("transaction_id").alias("transactions"),
                                            F.sum("lines").alias("lines"))


def customer_metrics_stored(totals: DataFrame, ci: DataFrame, visits: DataFrame) -> DataFrame:
    """``customer_metrics`` from the customer totals, the interaction table and the
    customer visits: no distinct count over fact rows."""
    base = totals.select("customer_id", F.col("transactions").alias("frequency"), F.col("last_date").alias("last_purchase_date"), "total_quantity")
    products = ci.groupBy("customer_id").agg(F.count("product_id").alias("unique_products"))
    categories = visits.groupBy("customer_id").agg(F.size(F.collect_set("category_id")).cast("long").alias("unique_categories"))
    lines = F.col("lines")
    stores = (visits.filter(F.col("store_id").isNotNull())
                    .groupBy("customer_id", "store_id").agg(F.sum("lines").alias("lines"))
                    .groupBy("customer_id").agg(F.min_by("store_id", F.struct(-lines, F.col("store_id")))
                                                .alias("preferred_store")))
    agg = _joined(_joined(_joined(base, products, "customer_id"), categories, "customer_id"), stores, "customer_id")
    return _customer_ratios(agg, base.select(F.col("last_purchase_date").alias("date")))


def product_totals(fact: DataFrame, exact: bool = True) -> DataFrame:
    """Per product: transactions, rows, units and the smallest non-null (id, name)
    category pair - a deterministic choice where the reference keeps the first
    row in file order. Totals of batches with their own transactions add up."""
    return fact.groupBy("product_id").agg(
        distinct_count("transaction_id", exact).alias("product_frequency"),
        F.count("quantity").alias("lines"),
        F.sum("quantity").alias("total_quantity"),
        F.min(F.when(F.col("category_id").isNotNull(), F.struct("category_id", "category_name"))).alias("category"))


def product_metrics_stored(totals: DataFrame, ci: DataFrame) -> DataFrame:
    """``product_metrics`` from the product totals, customers counted in the
    interaction table."""
    return _product_columns(totals, ci.groupBy("product_id").agg(F.count("customer_id").alias("unique_customers")))


def product_metrics(fact: DataFrame, exact: bool = True) -> DataFrame:
    """Per product: transactions, customers, units, mean units and its category."""
    return _product_columns(product_totals(fact, exact), fact.groupBy("product_id").agg(
        distinct_count("customer_id", exact).alias("unique_customers")))


def _product_columns(totals: DataFrame, buyers: DataFrame) -> DataFrame:
    return _joined(totals, buyers, "product_id").select(
        "product_id", "product_frequency", "unique_customers", "total_quantity",
        safe_div("total_quantity", "lines").alias("avg_quantity"),
        F.col("category.category_id").alias("category_id"), F.col("category.category_name").alias("category_name"))
