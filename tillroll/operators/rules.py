"""Market-basket analysis: baskets, frequent itemsets, association rules and
rule-based product recommendations."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame, Window, functions as F

from tillroll.functions.numeric import round_half_even
from tillroll.functions.text import NO_CATEGORY, product_name
from tillroll.session import written

MIN_SUPPORT = 0.02
MIN_CONFIDENCE = 0.4
MIN_LIFT = 1.0
TOP_N = 10


def baskets(lines: DataFrame, item: str = "product_id", tid: str = "transaction_id") -> DataFrame:
    """(transaction_id, items): the sorted set of distinct items of each basket.

    One shuffle on the basket id; collect_set deduplicates map-side, so a
    basket's buffer is bounded by the item catalogue and repeats (which
    FPGrowth rejects) are gone.
    """
    return (lines.select(F.col(tid).alias("transaction_id"), F.col(item).alias("item"))
                 .filter(F.col("item").isNotNull())
                 .groupBy("transaction_id").agg(F.array_sort(F.collect_set("item")).alias("items")))


def sample_baskets(b: DataFrame, max_transactions: int | None, seed: int = 42) -> DataFrame:
    """Exactly ``max_transactions`` baskets: those with the smallest hashes of id
    and seed, ties by id (stable across partitionings); None keeps every basket.

    Baskets under a hash bound that should hold a fifth more than n (doubled
    until it holds n) are written once, in ranges of the hash. A range's running
    total tells how many baskets come before it, so no task ranks them all.
    """
    if max_transactions is None:
        return b
    n = int(max_transactions)
    total = b.count()
    if total <= n:
        return b
    hashed = b.withColumn("_h", F.md5(F.concat_ws(":", F.col("transaction_id").cast("string"), F.lit(str(seed)))))
    share = 1.2 * n / total
    while True:
        few = hashed if share >= 1 else hashed.filter(F.col("_h") < format(int(share * 2**32), "08x"))
        few = written(few.repartitionByRange("_h", "transaction_id").withColumn("_range", F.spark_partition_id()),
                      "basket-sample")
        if share >= 1 or few.count() >= n:
            break
        share *= 2
    sizes = few.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))  # one row per range
    before = F.sum("_size").over(Window.partitionBy(F.lit(0)).orderBy("_range")) - F.col("_size")
    rank = F.row_number().over(Window.partitionBy("_range").orderBy("_h", "transaction_id"))
    return (few.join(sizes.select("_range", before.alias("_before")), "_range")
               .withColumn("_rank", F.col("_before") + rank).filter(F.col("_rank") <= n).select(*b.columns))


def frequent_itemsets(b: DataFrame, min_support: float = MIN_SUPPORT,
                      num_partitions: int | None = None) -> DataFrame:
    """(items sorted, freq, support) for every itemset with support >= min_support.

    Spark ML FPGrowth mines the itemsets in parallel (conditional trees are
    sharded by item over ``num_partitions``); only the frequent single items
    pass through the driver. Mining passes over the baskets several times, so
    they are written once.
    """
    b = written(b.select("items"), "baskets")
    fp = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=1.0)
    if num_partitions:
        fp = fp.setNumPartitions(num_partitions)
    model = fp.fit(b.select("items"))
    n = b.select(F.count(F.lit(1))).scalar()
    return model.freqItemsets.select(F.array_sort("items").alias("items"), F.col("freq").cast("bigint").alias("freq"),
                                     (F.col("freq") / n).alias("support"))


def association_rules(itemsets: DataFrame, min_confidence: float = MIN_CONFIDENCE,
                      min_lift: float | None = MIN_LIFT) -> DataFrame:
    """Every rule A -> C with A, C non-empty and A u C a frequent itemset.

    Consequents grow item by item (FPGrowth's own rules keep one item). Moving an
    item from A to C never raises the confidence, so only splits that reach
    ``min_confidence`` are grown further, each by items behind its last one, and
    the work follows the rules found. Supports are looked up by equi-joins on the
    sorted item arrays; subsets of a frequent itemset are frequent, so these hit.
    """
    sup = written(itemsets.select("items", "support"), "itemsets")
    a = sup.select(F.col("items").alias("antecedents"), F.col("support").alias("antecedent_support"))
    c = sup.select(F.col("items").alias("consequents"), F.col("support").alias("consequent_support"))
    longest = sup.agg(F.max(F.size("items"))).first()[0] or 0
    grown = sup.select("items", "support", F.array().cast(sup.schema["items"].dataType).alias("consequents"),
                       F.explode("items").alias("item"))
    found = []
    for size in range(1, max(longest, 2)):
        tried = grown.filter(F.size("items") > size).select("items", "support", F.array_append("consequents", F.col("item")).alias("consequents"))
        kept = tried.withColumn("antecedents", F.array_except("items", "consequents")).join(a, "antecedents")
        kept = written(kept.filter(F.col("support") / F.col("antecedent_support") >= min_confidence), "rules")
        found.append(kept)
        if kept.isEmpty():
            break
        behind = F.slice("items", F.array_position("items", F.element_at("consequents", -1)).cast("int") + 1, F.size("items"))
        grown = kept.select("items", "support", "consequents", F.explode(behind).alias("item"))
    r = reduce(DataFrame.unionByName, found).join(c, "consequents")
    conf = F.col("support") / F.col("antecedent_support")
    r = r.select("antecedents", "consequents", "antecedent_support", "consequent_support", "support",
                 conf.alias("confidence"))
    r = r.select("*", (F.col("confidence") / F.col("consequent_support")).alias("lift"),
                 (F.col("support") - F.col("antecedent_support") * F.col("consequent_support")).alias("leverage"),
                 F.when(F.col("confidence") < 1,
                        (1 - F.col("consequent_support")) / (1 - F.col("confidence")))
                  .otherwise(F.lit(float("inf"))).alias("conviction"))
    if min_lift is not None:
        r = r.filter(F.col("lift") >= min_lift)
    return r


def build_rules(lines: DataFrame, item: str = "product_id", min_support: float = MIN_SUPPORT,
                min_confidence: float = MIN_CONFIDENCE, min_lift: float | None = MIN_LIFT,
                max_transactions: int | None = None, seed: int = 42) -> DataFrame:
    b = sample_baskets(baskets(lines, item), max_transactions, seed)
    return association_rules(frequent_itemsets(b, min_support), min_confidence, min_lift)


def rule_stats(rules: DataFrame) -> DataFrame:
    return rules.agg(F.count(F.lit(1)).alias("n_rules"), F.avg("lift").alias("avg_lift"),
                     F.avg("confidence").alias("avg_confidence"), F.avg("support").alias("avg_support"))


def top_rules(rules: DataFrame, n: int = 5) -> DataFrame:
    return rules.orderBy(F.desc("lift"), F.desc("confidence"),
                         F.array_join(F.transform("antecedents", lambda x: x.cast("string")), "|"),
                         F.array_join(F.transform("consequents", lambda x: x.cast("string")), "|")).limit(n)


def _companions(rules: DataFrame, items: DataFrame | None) -> DataFrame:
    """(product_id, companion, support, confidence, lift) for each antecedent item
    and each consequent item different from it."""
    r = rules.select(F.explode("antecedents").alias("product_id"), "consequents", "support", "confidence", "lift")
    if items is not None:
        r = r.join(items.select("product_id").distinct(), "product_id", "left_semi")
    return (r.select("product_id", F.explode("consequents").alias("companion"), "support", "confidence", "lift")
             .filter(F.col("companion") != F.col("product_id")))


def _decorate(df: DataFrame, info: DataFrame | None) -> DataFrame:
    if info is None:
        return df.select("*", F.lit(None).cast("string").alias("category_name"),
                         product_name("companion").alias("product_name"))
    cols = [F.col("product_id").alias("companion"), "category_name"]
    if "product_name" in info.columns:
        cols.append("product_name")
    j = df.join(info.select(*cols), "companion", "left")
    if "product_name" not in info.columns:
        j = j.select("*", product_name("companion").alias("product_name"))
    return j


def product_recommendations(rules: DataFrame, items: DataFrame | None = None, top_n: int = TOP_N,
                            info: DataFrame | None = None) -> DataFrame:
    """Per antecedent product (all, or those in ``items``): companions with max
    support/confidence/lift over the rules, top N by lift, score = lift as % of
    the best, support and confidence in %, all rounded to 2 decimals."""
    g = _companions(rules, items).groupBy("product_id", "companion").agg(
        F.max("support").alias("support"), F.max("confidence").alias("confidence"), F.max("lift").alias("lift"))
    w = Window.partitionBy("product_id").orderBy(F.desc("lift"), "companion")
    top = g.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top_n)
    best = Window.partitionBy("product_id")  # at most top_n rows per product
    out = _decorate(top, info)
    return out.select(
        "product_id", "rank", F.col("companion").alias("recommended_id"),
        round_half_even(F.col("support") * 100, 2).alias("support"),
        round_half_even(F.col("confidence") * 100, 2).alias("confidence"),
        round_half_even(F.col("lift"), 2).alias("lift"),
        "category_name", F.coalesce("product_name", product_name("companion")).alias("product_name"),
        round_half_even(F.col("lift") / F.max("lift").over(best) * 100, 2).alias("score"))


def product_recommendations_weighted(rules: DataFrame, items: DataFrame | None = None, top_n: int = TOP_N,
                                     info: DataFrame | None = None) -> DataFrame:
    """Dashboard variant: mean support, max confidence and lift; top N by lift;
    score = 0.5 lift + 30 confidence + 20 support, unscaled."""
    g = _companions(rules, items).groupBy("product_id", "companion").agg(
        F.avg("support").alias("support"), F.max("confidence").alias("confidence"), F.max("lift").alias("lift"))
    w = Window.partitionBy("product_id").orderBy(F.desc("lift"), "companion")
    top = g.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top_n)
    out = _decorate(top, info)
    return out.select(
        "product_id", "rank", F.col("companion").alias("recommended_id"), "support", "confidence", "lift",
        F.coalesce("category_name", F.lit(NO_CATEGORY)).alias("category_name"),
        F.coalesce("product_name", product_name("companion")).alias("product_name"),
        (F.col("lift") * 0.5 + F.col("confidence") * 100 * 0.3 + F.col("support") * 100 * 0.2).alias("score"))
