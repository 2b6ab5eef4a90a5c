"""Top-N reports (bounded by N: TakeOrderedAndProject, no full sort)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tillroll.functions.numeric import safe_div
from tillroll.functions.text import product_label


def top_products(product_metrics: DataFrame, n: int = 10, metric: str = "total_quantity") -> DataFrame:
    return (product_metrics.orderBy(F.desc(metric), "product_id").limit(n)
            .select("*", product_label("product_id", "category_name").alias("label")))


def top_customers(customer_metrics: DataFrame, n: int = 10, metric: str = "frequency") -> DataFrame:
    return customer_metrics.orderBy(F.desc(metric), "customer_id").limit(n)


def top_categories(category_perf: DataFrame, n: int = 10) -> DataFrame:
    """Top N categories by units; ``share`` is the % within the N shown (pie)."""
    top = category_perf.orderBy(F.desc("total_units"), "category_name").limit(n)
    # window over at most n rows
    return top.select("*", safe_div(F.col("total_units") * 100.0,
                                    F.sum("total_units").over(Window.partitionBy())).alias("share"))
