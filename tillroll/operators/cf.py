"""User-based collaborative filtering on sparse customer x product quantities.

Nothing is pivoted: the interaction table stays in long form. For targets that
are a table of any size, similarity above a bound goes through an inverted index
of vector prefixes. Products are ordered by rarity; a vector's suffix are its
most popular products that together have a length below the bound. Two vectors
that share suffix products only can't reach the bound, so pairs are formed from
prefix products alone, and best-sellers mostly lie in suffixes (Bayardo, Ma and
Srikant 2007). A pair whose prefix products can't reach the bound with the
lengths of both suffixes goes next, and only the rest looks up its suffix
products. Products of many customers are dealt to a grid of salts, so no join key
has more than ``PER_KEY`` rows on either side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tillroll.functions.numeric import round_half_even
from tillroll.functions.text import product_name
from tillroll.session import written

TOP_N = 10
TOP_K_SIMILAR = 1000
MIN_SIMILARITY = 0.1
PER_KEY = 100_000  # rows of one join key, on either side
REST = 10_000  # steps of the lengths of suffixes, which only bound what a pair may still reach


def customer_item(fact: DataFrame) -> DataFrame:
    """(customer_id, product_id, quantity): units per customer and product."""
    return fact.groupBy("customer_id", "product_id").agg(F.sum("quantity").alias("quantity"))


def customer_norms(ci: DataFrame) -> DataFrame:
    return ci.groupBy("customer_id").agg(
        F.sqrt(F.sum(F.col("quantity") * F.col("quantity"))).alias("norm"))


def _own(ci: DataFrame, targets: DataFrame) -> DataFrame:
    """The targets' rows of a table keyed by customer."""
    return ci.join(targets.select(F.col("target_id").alias("customer_id")).distinct(), "customer_id", "left_semi")


def prefix_index(ci: DataFrame, targets: DataFrame, norms: DataFrame, min_similarity: float) -> DataFrame:
    """The interaction table as unit vectors, stored: (customer_id, product_id,
    weight, is_target, in_prefix, rest: the suffix's length, buyers, target_buyers:
    customers and targets who have the product), of the products that a target has.

    A window over a customer's own products; no product's rows meet in a task. Rows are
    shuffled by product for the counts and by customer for lengths and window, as units:
    a weight's digits would take most of the bytes, so it is computed on reading."""
    # stored, so that the planner knows how few they are
    chosen = written(targets.select(F.col("target_id").alias("customer_id")).distinct(), "cf-targets").withColumn("is_target", F.lit(True))
    known = ci.filter(F.col("customer_id").isNotNull())
    counts = known.join(chosen, "customer_id", "left").groupBy("product_id").agg(F.count(F.lit(1)).alias("buyers"), F.count("is_target").alias("target_buyers"))
    # products that no target has are part of no scalar product, and of lengths only by ``norms``
    rows = known.select("customer_id", "product_id", "quantity").join(counts.filter("target_buyers > 0"), "product_id")
    rows = rows.join(norms, "customer_id").filter("norm > 0").join(chosen, "customer_id", "left").withColumn("is_target", F.coalesce("is_target", F.lit(False)))
    popular = Window.partitionBy("customer_id").orderBy(F.desc("buyers"), "product_id").rowsBetween(Window.unboundedPreceding, 0)
    weight = F.col("quantity") / F.col("norm")
    so_far = F.sum(weight * weight).over(popular)
    # a little under the bound, so that rounding never moves a product out of the prefix
    within = so_far < F.lit(min_similarity * min_similarity * (1 - 1e-9))
    out = rows.withColumn("in_prefix", ~within)
    rest = F.sum(F.when(~F.col("in_prefix"), weight * weight).otherwise(0.0)).over(Window.partitionBy("customer_id"))
    index = written(out.withColumn("rest", F.sqrt(rest)), "cf-index")
    return index.withColumn("weight", weight).drop("quantity", "norm")


def customer_similarity(ci: DataFrame, targets: DataFrame, norms: DataFrame | None = None,
                        min_similarity: float | None = None) -> DataFrame:
    """Cosine similarity of each target to every other customer sharing a product.

    ``targets`` has a ``target_id`` column and any number of rows. With
    ``min_similarity`` only pairs that reach it are returned, and only pairs that
    share a prefix product are formed; without it every pair that shares a product
    is. Products of the two prefixes are summed by pair with map-side combine.
    ``norms`` may pass the stored lengths.
    """
    bound = min_similarity or 0.0
    index = prefix_index(ci, targets, customer_norms(ci) if norms is None else norms, bound)
    cells = F.ceil(F.col("buyers") / PER_KEY).cast("int")
    target_cells = F.greatest(F.ceil(F.col("target_buyers") / PER_KEY), F.lit(1)).cast("int")
    cell = lambda n: F.pmod(F.xxhash64("customer_id"), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    front = index.filter("in_prefix").withColumn("rest", F.ceil(F.col("rest") * REST).cast("int"))  # rounded up: few bytes a pair
    left = front.filter("is_target").select(
        F.col("customer_id").alias("target_id"), F.col("product_id").alias("p"), F.col("weight").alias("target_weight"), F.col("rest").alias("target_rest"),
        cell(target_cells).alias("tc"), cells.alias("cells")).select("*", each(F.col("cells")).alias("c")).drop("cells")
    right = front.select("customer_id", F.col("product_id").alias("p"), "weight", "rest", cell(cells).alias("c"), each(target_cells).alias("tc"))
    pairs = (left.join(right, ["p", "c", "tc"]).filter(F.col("customer_id") != F.col("target_id"))
                 .groupBy("target_id", "customer_id")
                 .agg(F.sum(F.col("weight") * F.col("target_weight")).alias("dot"), F.max(F.col("rest") + F.col("target_rest")).alias("rest")))
    if not bound:
        return pairs.select("target_id", "customer_id", F.col("dot").alias("similarity"))
    pairs = written(pairs.filter(F.col("dot") + F.col("rest") / REST >= bound * (1 - 1e-9)).select("target_id", "customer_id", "dot"), "cf-pairs")
    # shared products that lie in a suffix of either
    own = index.filter("is_target").select(F.col("customer_id").alias("target_id"), "product_id", F.col("weight").alias("target_weight"), F.col("in_prefix").alias("target_prefix"))
    other = index.select("customer_id", "product_id", "weight", "in_prefix")
    suffix = own.filter("NOT target_prefix")
    looked_up = written(suffix.select("product_id").distinct(), "cf-suffix")  # few at low bounds: the rest of the index isn't shuffled
    late = pairs.join(suffix, "target_id").join(other.join(looked_up, "product_id", "left_semi"), ["customer_id", "product_id"])
    early = pairs.join(other.filter("NOT in_prefix"), "customer_id").join(own.filter("target_prefix"), ["target_id", "product_id"])
    more = [x.select("target_id", "customer_id", (F.col("weight") * F.col("target_weight")).alias("dot")) for x in (late, early)]
    whole = pairs.unionByName(more[0]).unionByName(more[1]).groupBy("target_id", "customer_id").agg(F.sum("dot").alias("similarity"))
    return whole.filter(F.col("similarity") >= min_similarity)


def similar_customers(similarity: DataFrame, top_k: int = TOP_K_SIMILAR,
                      min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    """Per target: the top_k most similar customers (ties by id) with
    similarity >= min_similarity. The row_number filter becomes a partial
    per-partition limit before the shuffle, so no task receives a whole target's
    candidate list."""
    w = Window.partitionBy("target_id").orderBy(F.desc("similarity"), "customer_id")
    return (similarity.filter(F.col("similarity") >= min_similarity)
                      .withColumn("rank", F.row_number().over(w))
                      .filter(F.col("rank") <= top_k))


def product_info(fact: DataFrame) -> DataFrame:
    """One (product_id, category_name, product_name) per product: the smallest
    category id when a product has several; the data's product_name when the
    fact carries one, else 'Producto <id>'."""
    cat = F.min(F.when(F.col("category_id").isNotNull(), F.struct("category_id", "category_name")))
    name = F.min("product_name") if "product_name" in fact.columns else F.lit(None).cast("string")
    return fact.groupBy("product_id").agg(cat.alias("_c"), name.alias("_n")).select(
        "product_id", F.col("_c.category_name").alias("category_name"),
        F.coalesce(F.col("_n"), product_name("product_id")).alias("product_name"))


def customer_recommendations(fact: DataFrame, targets: DataFrame, top_n: int = TOP_N,
                             min_similarity: float = MIN_SIMILARITY,
                             top_k_similar: int = TOP_K_SIMILAR, ci: DataFrame | None = None,
                             products: DataFrame | None = None, norms: DataFrame | None = None) -> DataFrame:
    """Products a target has not bought, scored by sum(similarity x neighbour units).

    Score is then scaled to 0-100 of the target's best (2 decimals, half even);
    ``similar_customers_count`` is the number of all customers who bought the
    product. A target with no qualifying neighbour or candidate yields no rows.
    ``ci``, ``products`` and ``norms`` may pass the stored interaction table,
    product metrics and vector lengths; with the first two the fact is not read,
    and names and buyer counts are looked up for the chosen rows only.
    """
    ci = customer_item(fact) if ci is None else ci
    similarity = customer_similarity(ci, targets, norms, min_similarity)
    nb = similar_customers(similarity, top_k_similar, min_similarity)
    cand = nb.select("target_id", "customer_id", "similarity").join(ci, "customer_id")
    own = _own(ci, targets).select(F.col("customer_id").alias("target_id"), "product_id")
    scores = (cand.join(own, ["target_id", "product_id"], "left_anti")
                  .groupBy("target_id", "product_id")
                  .agg(F.sum(F.col("similarity") * F.col("quantity")).alias("raw_score")))
    w = Window.partitionBy("target_id").orderBy(F.desc("raw_score"), "product_id")
    top = scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top_n)
    if products is None:
        buyers = ci.groupBy("product_id").agg(F.count(F.lit(1)).alias("similar_customers_count"))
        info = product_info(fact).join(buyers, "product_id", "left")
    else:
        name = F.coalesce("product_name", product_name("product_id")) if "product_name" in products.columns \
            else product_name("product_id")
        info = products.select("product_id", "category_name", name.alias("product_name"),
                               F.col("unique_customers").alias("similar_customers_count"))
    best = Window.partitionBy("target_id")  # at most top_n rows per target
    return (top.join(info, "product_id", "left")
               .select(F.col("target_id").alias("customer_id"), "rank", "product_id",
                       round_half_even(F.col("raw_score") / F.max("raw_score").over(best) * 100.0, 2)
                       .alias("score"),
                       "category_name", "product_name", "similar_customers_count"))
