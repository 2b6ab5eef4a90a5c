"""Catalogue maintenance and transaction batches: key sets, keep-last dedupe,
upserts, append/replace, status."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tillroll.operators import facts
from tillroll.operators.baskets import build_fact, expand_baskets
from tillroll.operators.members import count_all
from tillroll.session import written


def undefined_keys(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Distinct keys referenced by ``child`` but absent from ``parent``."""
    return child.select(key).filter(F.col(key).isNotNull()).distinct().join(parent.select(key), key, "left_anti")


def kept_keys(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Keys of ``old`` that are still present in ``new``."""
    return old.select(key).distinct().join(new.select(key), key, "left_semi")


def dedupe_keep_last(df: DataFrame, key: str, order: str | list[str] = "pos") -> DataFrame:
    """One row per key: the one with the largest ``order`` value(s) (the last
    one read). An aggregation, so a hot key is combined map-side."""
    order = [order] if isinstance(order, str) else order
    others = [c for c in df.columns if c != key and c not in order]
    latest = F.max_by(F.struct(*others), F.struct(*order))
    return df.groupBy(key).agg(latest.alias("_v")).select(key, *[F.col(f"_v.{c}").alias(c) for c in others])


def upsert(existing: DataFrame, uploaded: DataFrame, key: str, mode: str = "add",
           order: str = "pos") -> DataFrame:
    """add: union, the uploaded row wins per key (last uploaded row among
    duplicates); replace: the uploaded rows only, deduplicated the same way."""
    cols = [c for c in existing.columns if c != order]
    up = uploaded.select(*cols, F.lit(1).alias("_src"), F.col(order).alias("_ord"))
    if mode == "replace":
        both = up
    elif mode == "add":
        both = existing.select(*cols, F.lit(0).alias("_src"),
                               (F.col(order) if order in existing.columns else F.lit(0)).cast("bigint").alias("_ord")) \
                       .unionByName(up.withColumn("_ord", F.col("_ord").cast("bigint")))
    else:
        raise ValueError("mode must be 'add' or 'replace'")
    return dedupe_keep_last(both, key, ["_src", "_ord"]).orderBy(key)


def upsert_report(existing: DataFrame, uploaded: DataFrame, result: DataFrame) -> DataFrame:
    """old / uploaded / new row counts, added = new - old, updated = uploaded - added."""
    old_n = existing.select(F.count(F.lit(1))).scalar()
    up_n = uploaded.select(F.count(F.lit(1))).scalar()
    return result.agg(F.count(F.lit(1)).alias("new_total")).select(
        old_n.alias("old_total"), up_n.alias("uploaded_rows"), "new_total",
        (F.col("new_total") - old_n).alias("added"), (up_n - (F.col("new_total") - old_n)).alias("updated"))


def batch_fact(raw: DataFrame, product_category: DataFrame, categories: DataFrame) -> DataFrame:
    """A raw basket batch (transaction_id, date, store_id, customer_id, products)
    expanded, enriched and given calendar columns."""
    lines = expand_baskets(raw.select("transaction_id", "date", "store_id", "customer_id", "products"))
    return build_fact(lines, product_category, categories)


def append_transactions(existing_fact: DataFrame, raw: DataFrame, product_category: DataFrame,
                        categories: DataFrame, mode: str = "append") -> DataFrame:
    """append: existing fact + the new batch; replace: the new batch only.
    Write the result to a new location (then switch readers to it) rather than
    over the table being read."""
    new = batch_fact(raw, product_category, categories).select(*existing_fact.columns)
    if mode == "replace":
        return new
    if mode != "append":
        raise ValueError("mode must be 'append' or 'replace'")
    return existing_fact.unionByName(new)


def append_summary(existing_fact: DataFrame, new_fact: DataFrame) -> DataFrame:
    """Rows, customers and products of the upload, and how many of those
    customers and products were not in the existing data."""
    new_c = new_fact.select("customer_id").distinct()
    new_p = new_fact.select("product_id").distinct()
    fresh_c = new_c.join(existing_fact.select("customer_id"), "customer_id", "left_anti") \
                   .select(F.count(F.lit(1))).scalar()
    fresh_p = new_p.join(existing_fact.select("product_id"), "product_id", "left_anti") \
                   .select(F.count(F.lit(1))).scalar()
    return new_fact.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("customer_id").alias("customers"),
                        F.count_distinct("product_id").alias("products")) \
                   .select("*", fresh_c.alias("new_customers"), fresh_p.alias("new_products"))


def append_summary_stored(customers: DataFrame, products: DataFrame, new_fact: DataFrame) -> DataFrame:
    """``append_summary`` against stored keys: tables with a row per customer and
    per product. The older fact is not read, and only the upload's distinct keys
    are looked up. The upload is expanded once, into a stored table of its keys,
    from which all figures are read."""
    new_fact = written(new_fact.select("customer_id", "product_id"), "append-keys")
    new_c, new_p = (new_fact.select(c).filter(F.col(c).isNotNull()).distinct() for c in ("customer_id", "product_id"))
    count = lambda df: df.select(F.count(F.lit(1))).scalar()
    fresh_c = count(new_c.join(customers.select("customer_id"), "customer_id", "left_anti"))
    fresh_p = count(new_p.join(products.select("product_id"), "product_id", "left_anti"))
    return new_fact.agg(F.count(F.lit(1)).alias("rows")).select(
        "rows", count(new_c).alias("customers"), count(new_p).alias("products"), fresh_c.alias("new_customers"), fresh_p.alias("new_products"))


def data_status_stored(totals: DataFrame, members: DataFrame) -> DataFrame:
    """``data_status`` from the category totals (for the rows) and the bitmaps of ids
    per day and store."""
    rows = totals.select(F.coalesce(F.sum("lines"), F.lit(0))).scalar()
    return members.agg(F.count_distinct("store_id").alias("stores"), F.min("date").alias("min_date"), F.max("date").alias("max_date")).select(
        rows.alias("rows"), count_all(members, "customer").alias("customers"), count_all(members, "product").alias("products"), "stores",
        "min_date", "max_date", F.datediff("max_date", "min_date").alias("days"))


def change_report(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Every key of two versions of a catalogue (a row per key each) with its
    ``change``: added, removed, changed or unchanged, and both versions' values. A
    null value differs from every other; a null key is a key like others."""
    values = [c for c in new.columns if c != key]
    a = old.select(F.col(key).alias("_old"), F.struct(*values).alias("before"))
    b = new.select(F.col(key).alias("_new"), F.struct(*values).alias("after"))
    both = a.join(b, F.col("_old").eqNullSafe(F.col("_new")), "full")
    change = (F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed")
               .when(F.col("before").eqNullSafe(F.col("after")), "unchanged").otherwise("changed"))
    return both.select(F.coalesce("_new", "_old").alias(key), change.alias("change"),
                       *[F.col(f"before.{c}").alias(f"old_{c}") for c in values], *[F.col(f"after.{c}").alias(f"new_{c}") for c in values])


def change_counts(changes: DataFrame) -> DataFrame:
    """How many keys were added, changed, removed and left as they were."""
    return changes.agg(*[F.count_if(F.col("change") == c).alias(c) for c in ("added", "changed", "removed", "unchanged")])


def data_status(fact: DataFrame) -> DataFrame:
    return fact.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("customer_id").alias("customers"),
                    F.count_distinct("product_id").alias("products"), F.count_distinct("store_id").alias("stores"),
                    F.min("date").alias("min_date"), F.max("date").alias("max_date")) \
               .select("*", F.datediff("max_date", "min_date").alias("days"))


def recompute_metrics(fact: DataFrame) -> dict[str, DataFrame]:
    return {"transaction_metrics": facts.transaction_metrics(fact),
            "customer_metrics": facts.customer_metrics(fact),
            "product_metrics": facts.product_metrics(fact)}
