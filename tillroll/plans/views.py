"""Page-level compositions: what one screen of the reference computes, as a
dict of lazy DataFrames over shared parents. Nothing is collected here."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tillroll.operators import baskets, cf, facts, kpis, rules, segments, temporal, topk


def dashboard(fact: DataFrame, product_metrics: DataFrame, customer_metrics: DataFrame,
              date_range=None, store=baskets.ALL, category=baskets.ALL, freq: str = "D",
              transaction_metrics: DataFrame | None = None) -> dict[str, DataFrame]:
    """Filters apply to the transaction views; top products / customers use the
    unfiltered metric tables, as in the reference. The series reads the stored
    ``transaction_metrics`` unless a category filter cuts baskets apart."""
    f = baskets.apply_filters(fact, date_range, store, category)
    if transaction_metrics is not None and category in (None, baskets.ALL):
        tx = baskets.apply_filters(transaction_metrics, date_range, store)
    else:
        tx = facts.transaction_metrics(f)
    return {
        "kpis": kpis.kpis(f),
        "top_products": topk.top_products(product_metrics, 10),
        "top_customers": topk.top_customers(customer_metrics, 10),
        "categories": topk.top_categories(kpis.category_performance(f), 10),
        "weekday_counts": temporal.weekday_counts(f),
        "series_units": temporal.time_series(tx, "units", freq),
    }


def product_page(fact: DataFrame, product_id, rules_df: DataFrame | None = None, top_n: int = 10,
                 item: str = "product_id", **rule_params) -> dict[str, DataFrame]:
    """Statistics of one product and its rule-based companions (both variants)."""
    spark = fact.sparkSession
    ids = spark.range(1).select(F.lit(product_id).alias("product_id"))
    if rules_df is None:
        rules_df = rules.build_rules(fact.select("transaction_id", item), item, **rule_params)
    return {
        "statistics": kpis.product_statistics(fact, ids),
        "recommendations": rules.product_recommendations(rules_df, ids, top_n, cf.product_info(fact)),
        "recommendations_weighted": rules.product_recommendations_weighted(rules_df, ids, top_n,
                                                                           cf.product_info(fact)),
    }


def customer_page(fact: DataFrame, customer_id, top_n: int = cf.TOP_N,
                  min_similarity: float = cf.MIN_SIMILARITY,
                  top_k_similar: int = cf.TOP_K_SIMILAR) -> dict[str, DataFrame]:
    spark = fact.sparkSession
    ids = spark.range(1).select(F.lit(customer_id).alias("customer_id"))
    targets = ids.select(F.col("customer_id").alias("target_id"))
    return {
        "statistics": kpis.customer_statistics(fact, ids),
        "recommendations": cf.customer_recommendations(fact, targets, top_n, min_similarity, top_k_similar),
    }


def segmentation(customer_metrics: DataFrame, k: int, features: list[str] | None = None,
                 n_init: int = segments.N_INIT, seed: int = segments.SEED) -> dict[str, DataFrame]:
    """Fit K-Means (eagerly: the fit is a series of Spark jobs) and return the
    segmented customers, profile, names, quality and the 2-D projection."""
    feats, used = segments.prepare_features(customer_metrics, features)
    labelled, _ = segments.fit_kmeans(feats, k, n_init, seed)
    labels = labelled.select("customer_id", "cluster")
    profile = segments.profile_clusters(customer_metrics.join(labels, "customer_id"))
    names = segments.name_clusters(profile)
    proj, ratios = segments.reduce_dimensions(labelled, 2)
    return {
        "customers": segments.segment_customers(customer_metrics, labels, names),
        "profile": profile,
        "names": names,
        "quality": segments.cluster_quality(labelled, len(used)),
        "projection": proj.join(names.select("cluster", F.col("name").alias("cluster_name")), "cluster", "left"),
        "explained_variance": customer_metrics.sparkSession.createDataFrame(
            [(i + 1, r) for i, r in enumerate(ratios)], "component int, ratio double"),
    }
