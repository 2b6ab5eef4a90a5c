"""Maps the driver's TPC-H-style tables onto the basket data model.

transaction = order (o_orderkey), date = order date, store = leading digit of
o_orderpriority, customer = o_custkey, product = l_partkey, quantity = summed
l_quantity of the order's lines for that part, category = p_brand (id = its
number).
"""

from __future__ import annotations

import threading

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tillroll.operators.baskets import build_fact


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("transaction_id"),
        F.col("o_orderdate").cast("date").alias("date"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("store_id"),
        F.col("o_custkey").alias("customer_id"))


def basket_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fact keys: one row per (order, part) with its unit count.

    Both sides are shuffled on the order key once; the aggregation on
    (order, part, ...) reuses that partitioning, so there is no second shuffle.
    Orders without lines (blank baskets) drop out of the inner join.
    """
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("transaction_id"),
        F.col("l_partkey").alias("product_id"), "l_quantity")
    return (li.join(orders(spark, sf_dir), "transaction_id")
              .groupBy("transaction_id", "date", "store_id", "customer_id", "product_id")
              .agg(F.sum("l_quantity").cast("bigint").alias("quantity")))


def product_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("product_id"),
        F.substring("p_brand", 7, 10).cast("int").alias("category_id"))


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.substring("p_brand", 7, 10).cast("int").alias("category_id"),
        F.col("p_brand").alias("category_name")).distinct()


def fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_fact(basket_lines(spark, sf_dir), product_category(spark, sf_dir),
                      categories(spark, sf_dir))


def basket_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw-format baskets: one row per order, products = its brand numbers.

    Each line contributes the number of its part's brand, so two lines of one
    brand make a repeated token (quantity 2 after expansion).
    """
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    part = table(spark, sf_dir, "part").select(
        "p_partkey", F.substring("p_brand", 7, 10).alias("token"))
    lines = li.join(part, li.l_partkey == part.p_partkey)
    per_order = lines.groupBy("l_orderkey").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "token"))),
                                 lambda s: s["token"]), " ").alias("products"))
    o = orders(spark, sf_dir)
    return o.join(per_order, o.transaction_id == per_order.l_orderkey, "left").select(
        "transaction_id", "date", "store_id", "customer_id", "products")


def part_basket_strings(spark: SparkSession, sf_dir: str, where: Column | None = None) -> DataFrame:
    """Raw-format baskets whose tokens are part keys, each repeated l_quantity
    times in line order, so expanding them gives back the fact's quantities.
    Orders without lines get an empty basket. Of the orders ``where`` holds for, if
    given: no text is made of the others."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    o = orders(spark, sf_dir)
    if where is not None:
        o = o.filter(where)
        li = li.join(o.select(F.col("transaction_id").alias("l_orderkey")), "l_orderkey", "left_semi")
    per_order = li.groupBy("l_orderkey").agg(F.array_join(F.flatten(F.transform(
        F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity"))),
        lambda s: F.array_repeat(s["l_partkey"].cast("string"), s["l_quantity"].cast("int")))), " ")
        .alias("products"))
    return o.join(per_order, o.transaction_id == per_order.l_orderkey, "left").select(
        "transaction_id", "date", "store_id", "customer_id", F.coalesce("products", F.lit("")).alias("products"))


FOREIGN_STORE_FILE = 9  # a file named for store 9 that holds store 1's rows: the gate must reject it

_RAW: dict = {}
_RAW_LOCK = threading.Lock()


def _once(spark: SparkSession, sf_dir: str, kind: str, write) -> dict:
    """What ``write(spark, sf_dir, a new folder)`` returns, once per application."""
    from tillroll.session import scratch_path
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"), kind)
    with _RAW_LOCK:
        if key not in _RAW:
            _RAW[key] = write(spark, sf_dir, scratch_path(spark, kind))
        return _RAW[key]


def raw_files(spark: SparkSession, sf_dir: str) -> dict:
    """Write raw-format inputs derived from the tables, once per application:
    one pipe-delimited headerless ``<store>_Tran.csv`` per store plus a
    mislabelled one, and the catalogues of ``raw_catalogues``."""
    return raw_catalogues(spark, sf_dir) | _once(spark, sf_dir, "raw", _write_raw_files)


def raw_catalogues(spark: SparkSession, sf_dir: str) -> dict:
    """The category catalogue (pipe, no header; and comma with header) and the
    product-category relation (pipe, 'v.Code' header). No basket is read for them."""
    return _once(spark, sf_dir, "raw-catalogues", _write_raw_catalogues)


def mixed_files(spark: SparkSession, sf_dir: str) -> dict:
    """Raw files in other layouts, derived from the tables, once per application:
    store 1 comma-separated with a header and every cell quoted, in order of the
    order key, every seventh order with a bad date and every eleventh with a bad
    customer id; store 2 without its products column; store 3 under a name that
    has no store number of its own; store 4 plain. Category names hold a comma."""
    return mixed_catalogues(spark, sf_dir) | _once(spark, sf_dir, "raw-mixed", _write_mixed_files)


def mixed_catalogues(spark: SparkSession, sf_dir: str) -> dict:
    """The catalogues of the mixed files, sound ones and uploads with faults."""
    return _once(spark, sf_dir, "mixed-catalogues", _write_mixed_catalogues)


def _by_store(baskets: DataFrame, name: str) -> DataFrame:
    """The baskets stored by store, in files of one size whatever the shuffles of the
    plan: a store's text comes in as many part files as its data fills."""
    from tillroll.session import scratch_path, small_tasks
    spark = baskets.sparkSession
    small_tasks(spark)
    path = scratch_path(spark, name)
    baskets.hint("rebalance", "store_id").write.option("compression", "zstd").partitionBy("store_id").parquet(path)
    return spark.read.schema(baskets.schema).parquet(path).select(*baskets.columns)  # the folder's column would come last


def _write_mixed_files(spark: SparkSession, sf_dir: str, root: str) -> dict:
    from tillroll.sources.files import write_delimited
    b = _by_store(part_basket_strings(spark, sf_dir), "baskets-mixed")
    text = [F.date_format("date", "yyyy-MM-dd").alias("date"), "store_id", F.col("customer_id").cast("string").alias("customer_id"), "products"]
    tid = F.col("transaction_id")
    bad_date, bad_customer = tid % 7 == 3, tid % 11 == 5
    # in as many ordered part files as its baskets fill, like the other stores; a plain
    # order would follow the number of cores, and a stream runs a batch for each two files
    parts = max(1, sum("/store_id=1/" in f for f in b.inputFiles()))
    one = b.filter("store_id = 1").repartitionByRange(parts, "transaction_id").sortWithinPartitions("transaction_id").select(
        F.when(bad_date, "never").otherwise(F.date_format("date", "yyyy-MM-dd")).alias("date"), "store_id",
        F.when(bad_customer, "x").otherwise(F.col("customer_id").cast("string")).alias("customer_id"), "products")
    one.write.option("header", True).option("quoteAll", True).option("compression", "gzip").csv(f"{root}/1_Tran.csv")
    write_delimited(b.filter("store_id = 2").select(*text[:3]), f"{root}/2_Tran.csv", sep=",", header=True, compression="gzip")
    write_delimited(b.filter("store_id = 3").select(*text), f"{root}/test_3_Tran.csv", compression="gzip")
    write_delimited(b.filter("store_id = 4").select(*text), f"{root}/4_Tran.csv", compression="gzip")
    return {"root": root}


def _write_mixed_catalogues(spark: SparkSession, sf_dir: str, root: str) -> dict:
    from tillroll.sources.files import write_delimited
    cats = categories(spark, sf_dir).select("category_id", F.concat(F.lit("Brand, "), F.col("category_id").cast("string")).alias("category_name"))
    write_delimited(cats, f"{root}/categories.csv", sep=",", header=True)
    write_delimited(product_category(spark, sf_dir), f"{root}/product_category.csv", sep=",", header=True)
    # uploads with faults: ids that are no numbers, a missing column
    wrong = F.when(F.col("category_id") % 10 == 3, F.concat(F.lit("x"), F.col("category_id").cast("string"))).otherwise(F.col("category_id").cast("string"))
    write_delimited(cats.select(wrong.alias("category_id"), "category_name"), f"{root}/categories_bad.csv", sep=",", header=True)
    write_delimited(cats.select("category_id", F.col("category_name").alias("label")), f"{root}/categories_short.csv", sep=",", header=True)
    part = table(spark, sf_dir, "part")
    number = F.col("p_partkey").cast("string")
    write_delimited(part.select(F.when(F.col("p_size") % 7 == 2, F.concat(F.lit("x"), number)).otherwise(number).alias("product_id"),
                                F.substring("p_brand", 7, 10).alias("category_id")), f"{root}/product_category_bad.csv", sep=",", header=True)
    return {"faulty": root, "categories": f"{root}/categories.csv", "product_category": f"{root}/product_category.csv"}


def _write_raw_files(spark: SparkSession, sf_dir: str, root: str) -> dict:
    from tillroll.sources.files import write_delimited
    b = _by_store(part_basket_strings(spark, sf_dir).select(
        F.date_format("date", "yyyy-MM-dd").alias("date"), F.col("store_id").cast("string").alias("store_id"),
        F.col("customer_id").cast("string").alias("customer_id"), "products"), "baskets-raw")
    stores = sorted(r[0] for r in b.select("store_id").distinct().collect())  # a handful of store ids
    for s in stores:
        write_delimited(b.filter(F.col("store_id") == s), f"{root}/{s}_Tran.csv", compression="gzip")
    write_delimited(b.filter(F.col("store_id") == stores[0]), f"{root}/{FOREIGN_STORE_FILE}_Tran.csv", compression="gzip")
    return {"root": root, "stores": stores}


def _write_raw_catalogues(spark: SparkSession, sf_dir: str, root: str) -> dict:
    from tillroll.sources.files import write_delimited
    cats = categories(spark, sf_dir)
    write_delimited(cats, f"{root}/categories.csv")
    write_delimited(cats, f"{root}/categories_header.csv", sep=",", header=True)
    pc = product_category(spark, sf_dir).select(F.col("product_id").alias("v.Code"),
                                                F.col("category_id").alias("Categoria"))
    write_delimited(pc, f"{root}/product_category.csv", header=True)
    return {"categories": f"{root}/categories.csv", "categories_header": f"{root}/categories_header.csv",
            "product_category": f"{root}/product_category.csv"}
