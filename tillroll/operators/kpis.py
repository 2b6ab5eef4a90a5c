"""Headline KPIs and summary aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tillroll.functions.numeric import distinct_count, safe_div
from tillroll.operators.members import count_all, count_members
from tillroll.operators.quantiles import quantiles


def _per_transaction(fact: DataFrame) -> DataFrame:
    return fact.groupBy("transaction_id").agg(
        F.count_distinct("product_id").alias("unique_products"),
        F.sum("quantity").alias("total_quantity"))


def kpis(fact: DataFrame, exact: bool = True) -> DataFrame:
    """One row: units, distinct transactions/customers/products/categories/stores,
    mean basket size and units per transaction, date span.

    Transaction-level figures come from one per-transaction aggregation folded
    in as a single struct-valued scalar subquery (no join of one-row tables).
    """
    per_tx = _per_transaction(fact).agg(F.struct(
        F.count(F.lit(1)).alias("n"),
        F.avg("unique_products").alias("avg_basket_size"),
        F.avg("total_quantity").alias("avg_units_per_transaction")).alias("s")).scalar()
    g = fact.agg(
        F.sum("quantity").alias("total_units"),
        distinct_count("customer_id", exact).alias("total_customers"),
        distinct_count("product_id", exact).alias("total_products"),
        distinct_count("category_id", exact).alias("total_categories"),
        distinct_count("store_id", exact).alias("total_stores"),
        F.min("date").alias("start_date"),
        F.max("date").alias("end_date"))
    return g.select(
        "total_units",
        per_tx["n"].alias("total_transactions"),
        "total_customers", "total_products", "total_categories", "total_stores",
        per_tx["avg_basket_size"].alias("avg_basket_size"),
        per_tx["avg_units_per_transaction"].alias("avg_units_per_transaction"),
        "start_date", "end_date",
        F.datediff("end_date", "start_date").alias("days"))


def kpis_stored(tx: DataFrame, members: DataFrame) -> DataFrame:
    """The figures of ``kpis`` from the transaction metrics and the bitmaps of ids
    per day and store: the fact is not read. Both tables may be filtered by the same
    dates and stores (``baskets.apply_filters``)."""
    n = {e: count_all(members, e) for e in ("customer", "product", "category")}
    g = tx.agg(F.sum("total_quantity").alias("total_units"), F.count(F.lit(1)).alias("total_transactions"),
               F.count_distinct("store_id").alias("total_stores"), F.avg("basket_size").alias("avg_basket_size"),
               F.avg("total_quantity").alias("avg_units_per_transaction"),
               F.min("date").alias("start_date"), F.max("date").alias("end_date"))
    return g.select("total_units", "total_transactions", n["customer"].alias("total_customers"),
                    n["product"].alias("total_products"), n["category"].alias("total_categories"), "total_stores",
                    "avg_basket_size", "avg_units_per_transaction", "start_date", "end_date",
                    F.datediff("end_date", "start_date").alias("days"))


def _group_counts(fact: DataFrame, key: str, exact: bool = True) -> DataFrame:
    return fact.groupBy(key).agg(
        F.sum("quantity").alias("total_units"),
        distinct_count("transaction_id", exact).alias("transactions"),
        distinct_count("customer_id", exact).alias("customers"),
        distinct_count("product_id", exact).alias("products"))


def category_performance(fact: DataFrame, exact: bool = True) -> DataFrame:
    """Per non-null category: units, transactions, customers, products, % of units."""
    per = _group_counts(fact.filter(F.col("category_name").isNotNull()), "category_name", exact)
    total = per.select(F.sum("total_units")).scalar()
    return per.select("*", safe_div(F.col("total_units") * 100.0, total).alias("percentage")) \
              .orderBy(F.desc("total_units"), "category_name")


def category_performance_stored(totals: DataFrame, members: DataFrame) -> DataFrame:
    """``category_performance`` from the category totals and bitmaps of ids."""
    named = totals.filter(F.col("category_name").isNotNull())
    per = named.select("category_name", "total_units", "transactions")
    for entity, name in (("customer", "customers"), ("product", "products")):
        per = per.join(count_members(members, ["category_name"], entity, name), "category_name", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    total = named.select(F.sum("total_units")).scalar()
    return per.select("*", safe_div(F.col("total_units") * 100.0, total).alias("percentage")) \
              .orderBy(F.desc("total_units"), "category_name")


def _store_ratios(per: DataFrame) -> DataFrame:
    return per.select("*", safe_div("total_units", "transactions").alias("avg_basket_size"),
                      safe_div("transactions", "customers").alias("avg_transactions_per_customer"))


def store_performance(fact: DataFrame, exact: bool = True) -> DataFrame:
    """Per store: units, transactions, customers, products and ratios."""
    return _store_ratios(_group_counts(fact, "store_id", exact))


def store_performance_stored(tx: DataFrame, members: DataFrame) -> DataFrame:
    """``store_performance`` from the transaction metrics and the bitmaps of ids per
    day and store; both may be filtered by the same dates."""
    per = tx.groupBy("store_id").agg(F.sum("total_quantity").alias("total_units"), F.count(F.lit(1)).alias("transactions"))
    for entity, name in (("customer", "customers"), ("product", "products")):
        n = count_members(members, ["store_id"], entity, name).withColumnRenamed("store_id", "_store")
        per = per.join(n, F.col("store_id").eqNullSafe(F.col("_store")), "left").withColumn(name, F.coalesce(name, F.lit(0))).drop("_store")
    return _store_ratios(per)


def segmentation_summary(customer_metrics: DataFrame) -> DataFrame:
    f, r = F.col("frequency"), F.col("recency")
    return customer_metrics.agg(
        F.count(F.lit(1)).alias("total_customers"),
        F.avg("frequency").alias("avg_frequency"),
        F.avg("recency").alias("avg_recency"),
        F.avg("total_quantity").alias("avg_total_quantity"),
        F.count_if(f <= 2).alias("freq_low"),
        F.count_if((f > 2) & (f <= 10)).alias("freq_medium"),
        F.count_if((f > 10) & (f <= 50)).alias("freq_high"),
        F.count_if(f > 50).alias("freq_very_high"),
        F.count_if(r <= 30).alias("recency_recent"),
        F.count_if((r > 30) & (r <= 90)).alias("recency_moderate"),
        F.count_if(r > 90).alias("recency_old"))


def product_penetration(product_metrics: DataFrame, total_customers) -> DataFrame:
    """% of all customers buying each product and transactions per buyer.

    ``total_customers`` may be a number or a Column (e.g. a scalar subquery).
    """
    tc = total_customers if not isinstance(total_customers, (int, float)) else F.lit(total_customers)
    return product_metrics.select(
        "*",
        safe_div(F.col("unique_customers") * 100.0, tc).alias("penetration"),
        safe_div("product_frequency", "unique_customers").alias("avg_frequency"),
    ).orderBy(F.desc("penetration"), "product_id")


def basket_analysis(tx: DataFrame) -> DataFrame:
    """Mean/median products and units per basket, mean categories per basket,
    from the transaction metrics."""
    med = {c: quantiles(tx, c, [0.5]).select(F.col("q")[0]).scalar() for c in ("basket_size", "total_quantity")}
    return tx.agg(
        F.avg("basket_size").alias("avg_products_per_basket"),
        F.avg("total_quantity").alias("avg_quantity_per_basket"),
        F.avg("category_diversity").alias("avg_categories_per_basket"),
    ).select("*", med["basket_size"].alias("median_products_per_basket"),
             med["total_quantity"].alias("median_quantity_per_basket"))


def basket_size_distribution(tx: DataFrame) -> DataFrame:
    return (tx.groupBy(F.col("basket_size").alias("unique_products"))
              .agg(F.count(F.lit(1)).alias("transactions"))
              .orderBy("unique_products"))


def daily_stats(tx: DataFrame) -> DataFrame:
    return tx.groupBy("date").agg(
        F.count(F.lit(1)).alias("transactions"),
        F.sum("total_quantity").alias("total_units"))


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """pandas-style describe in long form: one row per column with count, mean,
    sample sd, min, exact linear-interpolated quartiles, max."""
    stats = []
    for c in columns:
        x = F.col(c).cast("double")
        stats.append(F.struct(F.lit(c).alias("column"), F.count(x).alias("count"), F.avg(x).alias("mean"),
                              F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max")))
    # one aggregation pass, then one row per column
    out = df.agg(F.array(*stats).alias("_s")).select(F.inline("_s"))
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value"))
                                        for c in columns])))
    q = quantiles(long, "value", [0.25, 0.5, 0.75], "column")
    return out.join(q, "column", "left").select(
        "column", "count", "mean", "std", "min", F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"),
        F.col("q")[2].alias("q75"), "max")


def category_volume_top(fact: DataFrame, n: int = 5) -> DataFrame:
    return (fact.filter(F.col("category_name").isNotNull()).groupBy("category_name")
            .agg(F.sum("quantity").alias("total_units"))
            .orderBy(F.desc("total_units"), "category_name").limit(n))


def active_customers(customer_metrics: DataFrame, min_transactions: int = 5) -> DataFrame:
    return customer_metrics.filter(F.col("frequency") >= min_transactions)


def product_statistics(fact: DataFrame, product_ids: DataFrame | None = None) -> DataFrame:
    """Per product (all, or those in ``product_ids``): name (the data's own where
    it has one), category, units, distinct customers and transactions, mean units
    per row."""
    from tillroll.functions.text import category_or_default, product_name
    f = fact if product_ids is None else fact.join(product_ids.select("product_id"), "product_id", "left_semi")
    cat = F.min(F.when(F.col("category_id").isNotNull(), F.struct("category_id", "category_name")))
    return f.groupBy("product_id").agg(
        cat.alias("_cat"),
        (F.min("product_name") if "product_name" in fact.columns else F.lit(None).cast("string")).alias("_name"),
        F.sum("quantity").alias("total_quantity"),
        F.count_distinct("customer_id").alias("unique_customers"),
        F.count_distinct("transaction_id").alias("unique_transactions"),
        F.avg("quantity").alias("avg_quantity_per_transaction"),
    ).select("product_id", F.coalesce("_name", product_name("product_id")).alias("product_name"),
             category_or_default(F.col("_cat.category_name")).alias("category_name"),
             "total_quantity", "unique_customers", "unique_transactions",
             "avg_quantity_per_transaction")


def product_statistics_stored(product_metrics: DataFrame, product_ids: DataFrame | None = None) -> DataFrame:
    """``product_statistics`` from the stored product metrics."""
    from tillroll.functions.text import category_or_default, product_name
    pm = product_metrics if product_ids is None else product_metrics.join(product_ids.select("product_id"), "product_id", "left_semi")
    return pm.select("product_id", product_name("product_id").alias("product_name"), category_or_default(F.col("category_name")).alias("category_name"),
                     "total_quantity", "unique_customers", F.col("product_frequency").alias("unique_transactions"),
                     F.col("avg_quantity").alias("avg_quantity_per_transaction"))


def customer_statistics_stored(totals: DataFrame, ci: DataFrame, visits: DataFrame) -> DataFrame:
    """``customer_statistics`` from the customer totals, the interaction table and
    the customer visits, all in buckets of the customer."""
    products = ci.groupBy("customer_id").agg(F.count("product_id").alias("unique_products"))
    units = visits.groupBy("customer_id", "category_name").agg(F.sum("quantity").alias("q"), F.sum("lines").alias("rows"))
    named = F.when(F.col("category_name").isNotNull(), F.struct(-F.col("q"), F.col("category_name")))
    per = units.groupBy("customer_id").agg(F.count("category_name").alias("unique_categories"), F.sum("rows").alias("_rows"),
                                           F.min_by("category_name", named).alias("favorite_category"))
    out = totals
    for right in (products, per):
        right = right.withColumnRenamed("customer_id", "_key")
        out = out.join(right, F.col("customer_id").eqNullSafe(F.col("_key")), "left").drop("_key")
    return out.select("customer_id", F.col("transactions").alias("total_transactions"), "total_quantity", F.coalesce("unique_products", F.lit(0)).alias("unique_products"),
                      "unique_categories", "favorite_category", (F.col("_rows") / F.col("transactions")).alias("avg_products_per_transaction"))


def customer_statistics(fact: DataFrame, customer_ids: DataFrame | None = None) -> DataFrame:
    """Per customer: transactions, units, products, categories (by name), the
    favourite category by units (ties alphabetical) and mean rows per transaction.

    Both aggregations are keyed by customer, so their join needs no new shuffle.
    """
    f = fact if customer_ids is None else fact.join(customer_ids.select("customer_id"), "customer_id", "left_semi")
    base = f.groupBy("customer_id").agg(
        F.count_distinct("transaction_id").alias("total_transactions"),
        F.sum("quantity").alias("total_quantity"),
        F.count_distinct("product_id").alias("unique_products"),
        F.count_distinct("category_name").alias("unique_categories"),
        F.count(F.lit(1)).alias("_rows"))
    fav = (f.filter(F.col("category_name").isNotNull())
            .groupBy("customer_id", "category_name").agg(F.sum("quantity").alias("q"))
            .groupBy("customer_id")
            .agg(F.min_by("category_name", F.struct(-F.col("q"), F.col("category_name")))
                 .alias("favorite_category")))
    return base.join(fav, "customer_id", "left").select(
        "customer_id", "total_transactions", "total_quantity", "unique_products",
        "unique_categories", "favorite_category",
        (F.col("_rows") / F.col("total_transactions")).alias("avg_products_per_transaction"))
