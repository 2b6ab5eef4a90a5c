"""Rebuild: raw basket files + catalogues -> processed warehouse."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from tillroll.operators import catalog, quality
from tillroll.operators.baskets import build_fact, expand_baskets, parse_product_ids, transaction_ids
from tillroll.operators.known import known_keys
from tillroll.plans.warehouse import KnownTransactions, Warehouse, append_processed, write_processed
from tillroll.session import written
from tillroll.sources import files


def raw_batch(rows: DataFrame, batch: str | None = None) -> DataFrame:
    """Gate-passed text rows -> typed baskets with a transaction id
    '<store>_<customer>_[batch_]<line>', by the line's number in its store file
    (the same for any read splits); no task has to sort a whole file."""
    typed = files.typed_transactions(rows)
    return typed.select(transaction_ids(typed, "row_no", batch).alias("transaction_id"),
                        "date", "store_id", "customer_id", "products")


class InvalidLoad(ValueError):
    """The transactions of a load are not whole; ``figures`` has the counts."""

    def __init__(self, figures: dict):
        self.figures = figures
        super().__init__(f"{figures['null_date']} rows without a usable date, {figures['null_customer_id']} without a usable "
                         f"customer id, {figures['null_products']} without products (of {figures['rows']})")


def rebuild(spark: SparkSession, raw_dir: str, categories_path, product_category_path, out_root: str,
            store_ids=None, with_integrity: bool = False, on_invalid: str = "raise"):
    """Load (with the store gate), expand, enrich, add calendar, write the four
    processed tables. Returns the warehouse and the per-file gate report (and
    the integrity report of the loaded inputs when ``with_integrity``).

    Each text file is scanned once, into a landing table in the shared folder.
    Rows whose date or customer id does not parse are written to
    ``<out_root>/rejected`` and counted per file in the report; no accepted file
    at all is an error. While the fact is written, the baskets that go into it
    are counted; if some have no date, customer or products, the load is invalid
    and raises InvalidLoad before anything is published, or with
    ``on_invalid='reject'`` goes on without those rows. Should a lost executor
    make Spark repeat part of the write, the figures may count rows twice, but a
    figure is zero exactly if there are no such rows."""
    if on_invalid not in ("raise", "reject"):
        raise ValueError("on_invalid must be 'raise' or 'reject'")
    rows, report = files.load_transactions(spark, raw_dir, store_ids)
    if report.filter("accepted").isEmpty():
        raise ValueError(f"no store file in {raw_dir} was accepted: "
                         + "; ".join(f"{r['source']}: {r['reason']}" for r in report.limit(10).collect()))
    files.rejected_rows(rows).write.mode("overwrite").parquet(f"{out_root.rstrip('/')}/rejected")
    cats = files.load_categories(spark, categories_path).drop("pos")
    pc = files.load_product_category(spark, product_category_path).drop("pos")
    seen = Observation("load")
    raw = raw_batch(rows.observe(seen, *files.load_figures()))
    lines = expand_baskets(raw.filter(F.col("date").isNotNull() & F.col("customer_id").isNotNull()))

    def check():
        figures = seen.get
        if on_invalid == "raise" and figures["null_date"] + figures["null_customer_id"] + figures["null_products"]:
            raise InvalidLoad(figures)

    wh = write_processed(spark, build_fact(lines, pc, cats), out_root, check=check)
    if with_integrity:
        return wh, report, quality.integrity_report(files.typed_transactions(rows), pc, cats)
    return wh, report


def append_batch(spark: SparkSession, wh: Warehouse, raw: DataFrame, product_category: DataFrame,
                 categories: DataFrame, new_root: str, mode: str = "append",
                 batch_id: str | None = None, on_known: str = "raise") -> Warehouse:
    """Append (or replace with) a typed basket batch and publish a new
    warehouse version at ``new_root``. The current version is only referred to,
    so a failure leaves it intact; readers switch by using the returned handle
    (or ``Warehouse.open(spark, new_root)``). Appending does not read the old
    fact; its cost follows the batch and the buckets it touches. A transaction id
    that stands on two baskets of the batch raises KnownTransactions, and so does
    one that is stored already unless ``on_known`` is 'skip'."""
    twice = raw.groupBy("transaction_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    examples = [r[0] for r in twice.limit(5).collect()]
    if examples:
        raise KnownTransactions("transaction ids stand on several baskets of the batch", twice.count(), examples)
    if mode not in ("append", "replace"):
        raise ValueError("mode must be 'append' or 'replace'")
    if mode == "append" and (batch_id is None or batch_id not in wh.batches):
        raw = _without_known(raw, wh, on_known)
    new = catalog.batch_fact(raw, product_category, categories)
    if mode == "replace":
        return write_processed(spark, new, new_root, batches=[batch_id] if batch_id else [])
    return append_processed(spark, wh, new, new_root, batch_id, on_known, checked=True)


def _without_known(raw: DataFrame, wh: Warehouse, on_known: str) -> DataFrame:
    """The baskets without those whose ids are stored already, found before any is
    expanded, or KnownTransactions. A basket without products is no transaction."""
    known = written(known_keys(raw, wh.transaction_metrics(), "transaction_id"), "append-known")
    if known.isEmpty():
        return raw
    if on_known == "raise":
        sold = raw.join(known, "transaction_id", "left_semi").filter(F.size(parse_product_ids(F.col("products"))) > 0)
        sold = written(sold.select("transaction_id"), "append-refused")
        examples = [r[0] for r in sold.limit(5).collect()]
        if examples:
            raise KnownTransactions("transactions are stored already", sold.count(), examples)
    return raw.join(known, "transaction_id", "left_anti")
