"""Registered checks: file sources, validation, catalogue upserts, batches,
sinks, rebuild and streaming ingestion. Every input is derived by Spark from
the given tables (raw files are written to the shared folder first)."""

from __future__ import annotations

import datetime as dt

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tillroll.operators import baskets, catalog, facts, kpis, quality
from tillroll.plans import dashboard, mining  # noqa: F401  (register oracles reused below)
from tillroll.plans.oracle_sql import LINES, PRODUCT_METRICS, with_ctes
from tillroll.plans.rebuild import InvalidLoad, append_batch, rebuild
from tillroll.plans.registry import ORACLES, QUERIES, comparable, register
from tillroll.plans.warehouse import TABLES, KnownTransactions, Warehouse, testdata_warehouse, write_processed
from tillroll.session import scratch_path
from tillroll.schemas import CATEGORY_COLUMNS, PRODUCT_CATEGORY_COLUMNS, TRANSACTION_COLUMNS
from tillroll.sources import files, sinks, testdata
from tillroll.streaming.ingest import ingest_stream

CUTOFF = dt.date(1998, 1, 1)  # batches: orders before it exist, orders from it on are uploaded


def _raw(spark, sf):
    return testdata.raw_files(spark, sf)


def _loaded(spark, sf):
    r = _raw(spark, sf)
    return files.load_transactions(spark, r["root"])


def _brands(spark, sf):
    return testdata.categories(spark, sf)


def _existing_categories(spark, sf):
    part = testdata.table(spark, sf, "part").filter(F.col("p_size") <= 25)
    return part.select(F.substring("p_brand", 7, 10).cast("int").alias("category_id"),
                       F.col("p_brand").alias("category_name")).distinct() \
               .select("*", F.col("category_id").cast("bigint").alias("pos"))


def _uploaded_categories(spark, sf):
    part = testdata.table(spark, sf, "part").filter(F.col("p_size") > 25)
    return part.select(F.substring("p_brand", 7, 10).cast("int").alias("category_id"),
                       F.lower("p_brand").alias("category_name")).distinct() \
               .select("*", F.col("category_id").cast("bigint").alias("pos"))


def _line_relation(spark, sf):
    """An uploaded product-category relation with many duplicate products:
    one row per order line (part, line number), read in (order, line) order."""
    li = testdata.table(spark, sf, "lineitem")
    return li.select(F.col("l_partkey").alias("product_id"), F.col("l_linenumber").cast("int").alias("category_id"),
                     (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))


def _size_relation(spark, sf):
    """A product-category relation keyed by part size, whose ids partly miss
    from the brand catalogue."""
    return testdata.table(spark, sf, "part").select(F.col("p_partkey").alias("product_id"),
                                                    F.col("p_size").alias("category_id"))


_BRANDS = "brands AS (SELECT DISTINCT CAST(substr(p_brand, 7) AS INTEGER) AS category_id, p_brand AS category_name FROM part)"
_EXISTING = ("ex AS (SELECT DISTINCT CAST(substr(p_brand, 7) AS INTEGER) AS category_id, p_brand AS category_name "
             "FROM part WHERE p_size <= 25)")
_UPLOADED = ("up AS (SELECT DISTINCT CAST(substr(p_brand, 7) AS INTEGER) AS category_id, lower(p_brand) AS category_name "
             "FROM part WHERE p_size > 25)")
_LINEREL = ("lr AS (SELECT l_partkey AS product_id, CAST(l_linenumber AS INTEGER) AS category_id, "
            "l_orderkey * 10 + l_linenumber AS pos FROM lineitem)")
_ORDERS = """ob AS (
  SELECT o.o_orderkey, CAST(o.o_orderdate AS DATE) AS date, CAST(substr(o.o_orderpriority, 1, 1) AS INTEGER) AS store_id,
         o.o_custkey AS customer_id, CAST(coalesce(sum(l.l_quantity), 0) AS INTEGER) AS n_tokens,
         count(l.l_orderkey) AS n_lines
  FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY 1, 2, 3, 4)"""


# ---------------------------------------------------------------- sources

@register("src_transactions", with_ctes(_ORDERS, select="SELECT date, store_id, customer_id, n_tokens FROM ob"))
def q_src_transactions(spark, sf):
    rows, _ = _loaded(spark, sf)
    t = files.typed_transactions(rows)
    n = F.size(F.filter(F.split(F.trim("products"), r"\s+"), lambda x: x != ""))
    return t.select("date", "store_id", "customer_id", n.alias("n_tokens"))


@register("store_file_gate", with_ctes(_ORDERS, select=f"""
SELECT CAST(store_id AS VARCHAR) AS file_store, count(*) AS rows, CAST(0 AS BIGINT) AS foreign_rows, true AS accepted
FROM ob GROUP BY store_id
UNION ALL
SELECT '{testdata.FOREIGN_STORE_FILE}', count(*), count(*), false FROM ob
WHERE store_id = (SELECT min(store_id) FROM ob)"""))
def q_store_file_gate(spark, sf):
    _, report = _loaded(spark, sf)
    return report.select("file_store", "rows", "foreign_rows", "accepted")


@register("src_categories", with_ctes(_BRANDS, select="SELECT category_id, category_name FROM brands"))
def q_src_categories(spark, sf):
    return files.load_categories(spark, testdata.raw_catalogues(spark, sf)["categories"]).drop("pos")


@register("src_categories_header", with_ctes(_BRANDS, select="SELECT category_id, category_name FROM brands"))
def q_src_categories_header(spark, sf):
    return files.load_categories(spark, testdata.raw_catalogues(spark, sf)["categories_header"]).drop("pos")


@register("src_product_category", """
SELECT p_partkey AS product_id, CAST(substr(p_brand, 7) AS INTEGER) AS category_id FROM part""")
def q_src_product_category(spark, sf):
    return files.load_product_category(spark, testdata.raw_catalogues(spark, sf)["product_category"]).drop("pos")


@register("sniff_format", with_ctes(_ORDERS, select=f"""
SELECT CAST(store_id AS VARCHAR) || '_Tran.csv' AS source, '|' AS delimiter, false AS has_header, 4 AS n_columns,
       CAST(NULL AS VARCHAR) AS missing_columns, true AS ok FROM (SELECT DISTINCT store_id FROM ob)
UNION ALL SELECT * FROM (VALUES ('{testdata.FOREIGN_STORE_FILE}_Tran.csv', '|', false, 4, NULL, true),
  ('categories.csv', '|', false, 2, NULL, true), ('categories_header.csv', ',', true, 2, NULL, true),
  ('product_category.csv', '|', false, 2, NULL, true), ('1_Tran.csv mixed', ',', true, 4, NULL, true),
  ('2_Tran.csv mixed', ',', true, 3, 'products', false), ('test_3_Tran.csv mixed', '|', false, 4, NULL, true),
  ('4_Tran.csv mixed', '|', false, 4, NULL, true))"""))
def q_sniff_format(spark, sf):
    """Layout of every raw file by the columns of its kind (one row per layout of a source)."""
    r, mixed = _raw(spark, sf), testdata.mixed_files(spark, sf)
    kinds = [([f"{r['root']}/*_Tran.csv", f"{mixed['root']}/*_Tran.csv"], TRANSACTION_COLUMNS),
             ([r["categories"], r["categories_header"]], CATEGORY_COLUMNS),
             ([r["product_category"]], PRODUCT_CATEGORY_COLUMNS)]
    fmt = reduce(DataFrame.unionByName, [files.sniff_format(files.land(spark, p), columns) for p, columns in kinds])
    src = F.concat(F.regexp_extract("file_path", r"/([^/]+)/[^/]+$", 1),
                   F.when(F.contains("file_path", F.lit("/raw-mixed-")), " mixed").otherwise(""))
    missing = F.when(F.size("missing_columns") > 0, F.array_join("missing_columns", "|"))
    return fmt.select(src.alias("source"), "delimiter", "has_header", "n_columns", missing.alias("missing_columns"), "ok").distinct()


# orders of the mixed files' store 1 that have a bad date, a bad customer id
_MIXED = """
mx AS (SELECT o.o_orderkey, CAST(o.o_orderdate AS DATE) AS date, CAST(substr(o.o_orderpriority, 1, 1) AS INTEGER) AS store_id,
              o.o_custkey AS customer_id, o_orderkey % 7 = 3 AND substr(o.o_orderpriority, 1, 1) = '1' AS bad_date,
              o_orderkey % 11 = 5 AND substr(o.o_orderpriority, 1, 1) = '1' AS bad_customer FROM orders o)"""


@register("gate_report", with_ctes(_MIXED, select="""
SELECT source, rows, foreign_rows, bad_dates, bad_customer_ids, layout_ok, missing_columns, reason, accepted FROM (
  SELECT '1_Tran.csv' AS source, count(*) AS rows, 0::BIGINT AS foreign_rows, count(*) FILTER (WHERE bad_date) AS bad_dates,
         count(*) FILTER (WHERE bad_customer) AS bad_customer_ids, true AS layout_ok, '' AS missing_columns,
         CAST(NULL AS VARCHAR) AS reason, true AS accepted FROM mx WHERE store_id = 1
  UNION ALL SELECT '2_Tran.csv', 0, 0, 0, 0, false, 'products', 'columns missing or surplus', false
  UNION ALL SELECT 'test_3_Tran.csv', count(*), count(*), 0, 0, true, '', 'file name has no store number of its own', false
            FROM mx WHERE store_id = 3
  UNION ALL SELECT '4_Tran.csv', count(*), 0, 0, 0, true, '', NULL, true FROM mx WHERE store_id = 4)"""))
def q_gate_report(spark, sf):
    """Every file of the mixed folder with its counts and the reason of a rejection."""
    _, report = files.load_transactions(spark, testdata.mixed_files(spark, sf)["root"])
    return comparable(report.select(F.regexp_extract("source", r"([^/]+)$", 1).alias("source"), "rows", "foreign_rows",
                                    "bad_dates", "bad_customer_ids", "layout_ok", "missing_columns", "reason", "accepted"))


@register("rejected_rows", with_ctes(_MIXED, select="""
SELECT CASE WHEN bad_date THEN 'never' ELSE strftime(date, '%Y-%m-%d') END AS date, '1' AS store_id,
       CASE WHEN bad_customer THEN 'x' ELSE CAST(customer_id AS VARCHAR) END AS customer_id,
       CASE WHEN bad_date THEN 'bad date' ELSE 'bad customer id' END AS reason FROM mx WHERE bad_date OR bad_customer"""))
def q_rejected_rows(spark, sf):
    rows, _ = files.load_transactions(spark, testdata.mixed_files(spark, sf)["root"])
    return files.rejected_rows(rows).select("date", "store_id", "customer_id", "reason")


@register("src_categories_quoted", with_ctes(_BRANDS, select="""
SELECT category_id, 'Brand, ' || category_id AS category_name FROM brands"""))
def q_src_categories_quoted(spark, sf):
    return files.load_categories(spark, testdata.mixed_catalogues(spark, sf)["categories"]).drop("pos")


@register("rebuild_mixed", with_ctes(LINES, _MIXED, select="""
SELECT f.date, f.store_id, f.customer_id, f.product_id, f.quantity, f.category_id, 'Brand, ' || f.category_id AS category_name
FROM fact f JOIN mx ON mx.o_orderkey = f.transaction_id
WHERE f.store_id IN (1, 4) AND NOT mx.bad_date AND NOT mx.bad_customer"""))
def q_rebuild_mixed(spark, sf):
    """Fact rows of a rebuild of the mixed folder: quoted baskets whole, rejected files and rows left out."""
    r = testdata.mixed_files(spark, sf)
    wh, _ = rebuild(spark, r["root"], r["categories"], r["product_category"], scratch_path(spark, "rebuild-mixed"), on_invalid="reject")
    return wh.fact().select("date", "store_id", "customer_id", "product_id", "quantity", "category_id", "category_name")


@register("load_valid", with_ctes(_ORDERS, select="""
SELECT count(*) AS rows, 0::BIGINT AS null_date, 0::BIGINT AS null_customer_id, 0::BIGINT AS null_products, true AS published FROM ob"""))
def q_load_valid(spark, sf):
    """What a rebuild of whole files observes while it writes the fact."""
    return _load_outcome(spark, _raw(spark, sf), "load-valid")


@register("load_invalid", with_ctes(_MIXED, select="""
SELECT count(*) AS rows, count(*) FILTER (WHERE bad_date) AS null_date, count(*) FILTER (WHERE bad_customer) AS null_customer_id,
       0::BIGINT AS null_products, false AS published FROM mx WHERE store_id IN (1, 4)"""))
def q_load_invalid(spark, sf):
    """The same of the mixed folder: the load raises and nothing is published."""
    return _load_outcome(spark, testdata.mixed_files(spark, sf), "load-invalid")


def _load_outcome(spark, r, name):
    root = scratch_path(spark, name)
    try:
        wh, report = rebuild(spark, r["root"], r["categories"], r["product_category"], root)
        good = report.filter("accepted").agg(F.sum("rows").alias("rows"), F.sum("bad_dates").alias("null_date"), F.sum("bad_customer_ids").alias("null_customer_id"))
        published = F.lit(Warehouse.open(spark, wh.root).fact().schema == wh.fact().schema)
        return good.select("*", F.lit(0).cast("bigint").alias("null_products"), published.alias("published"))
    except InvalidLoad as e:
        return spark.range(1).select(*[F.lit(v).cast("bigint").alias(k) for k, v in e.figures.items()], F.lit(False).alias("published"))


_BAD_CATEGORIES = """
SELECT 'categories.csv' AS file, count(*) AS rows, 0::BIGINT AS bad_rows, '' AS missing_columns, true AS accepted, CAST(NULL AS VARCHAR) AS reason FROM brands
UNION ALL SELECT 'categories_bad.csv', count(*), count(*) FILTER (WHERE category_id % 10 = 3), '', false, 'ids that are not numbers' FROM brands
UNION ALL SELECT 'categories_short.csv', count(*), 0, 'category_name', false, 'columns missing or surplus' FROM brands
UNION ALL SELECT 'product_category.csv', count(*), 0, '', true, NULL FROM part
UNION ALL SELECT 'product_category_bad.csv', count(*), count(*) FILTER (WHERE p_size % 7 = 2), '', true, NULL FROM part"""


@register("catalogue_report", with_ctes(_BRANDS, select=_BAD_CATEGORIES))
def q_catalogue_report(spark, sf):
    """Every catalogue file of the mixed folder with its faults."""
    r = testdata.mixed_catalogues(spark, sf)
    reports = [files.read_catalogue(spark, r["faulty"] + "/categories*.csv", "categories")[2],
               files.read_catalogue(spark, r["faulty"] + "/product_category*.csv", "product_category")[2]]
    one = reports[0].unionByName(reports[1])
    source = F.regexp_extract("file_path", r"/([^/]+)/[^/]+$", 1).alias("file")  # a folder of part files is one upload
    per = one.groupBy(source).agg(
        F.sum("rows").alias("rows"), F.sum("bad_rows").alias("bad_rows"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("missing_columns")))), "|").alias("missing_columns"),
        F.bool_and("accepted").alias("accepted"), F.min("reason").alias("reason"))
    return per.select("file", "rows", "bad_rows", "missing_columns", "accepted", "reason")


@register("catalogue_rejected", """
SELECT 'x' || CAST(p_partkey AS VARCHAR) AS product_id, substr(p_brand, 7) AS category_id FROM part WHERE p_size % 7 = 2""")
def q_catalogue_rejected(spark, sf):
    """The catalogue lines that can't be used, as they were read."""
    r = testdata.mixed_catalogues(spark, sf)
    return files.read_catalogue(spark, r["faulty"] + "/product_category_bad.csv", "product_category")[1].select("product_id", "category_id")


# ---------------------------------------------------------------- validation

@register("upload_stats", with_ctes(_ORDERS, select="""
SELECT (SELECT count(*) FROM ob) AS rows, (SELECT count(DISTINCT customer_id) FROM ob) AS customers,
       (SELECT count(DISTINCT store_id) FROM ob) AS stores,
       (SELECT count(DISTINCT l_partkey) FROM lineitem) AS products"""))
def q_upload_stats(spark, sf):
    rows, _ = _loaded(spark, sf)
    return quality.upload_stats(rows)


@register("validate_transactions", with_ctes(_ORDERS, """
c AS (SELECT count(*) FILTER (WHERE n_lines = 0) AS null_products,
             count(*) FILTER (WHERE store_id <= 0) AS nonpositive_store_id,
             count(*) FILTER (WHERE customer_id <= 0) AS nonpositive_customer_id FROM ob)""", select="""
SELECT "check", ok, CAST(n_bad AS BIGINT) AS n_bad FROM
  (VALUES ('invalid_dates', true, 0), ('null_date', true, 0), ('null_store_id', true, 0),
          ('null_customer_id', true, 0)) AS t("check", ok, n_bad)
UNION ALL SELECT 'null_products', null_products = 0, null_products FROM c
UNION ALL SELECT 'nonpositive_store_id', nonpositive_store_id = 0, nonpositive_store_id FROM c
UNION ALL SELECT 'nonpositive_customer_id', nonpositive_customer_id = 0, nonpositive_customer_id FROM c
UNION ALL SELECT 'all_valid', null_products + nonpositive_store_id + nonpositive_customer_id = 0,
                 null_products + nonpositive_store_id + nonpositive_customer_id FROM c"""))
def q_validate_transactions(spark, sf):
    rows, _ = _loaded(spark, sf)
    return quality.validate_transactions(rows)


@register("validate_categories", with_ctes(_EXISTING, _UPLOADED, "u AS (SELECT * FROM ex UNION ALL SELECT * FROM up)",
                                           "d AS (SELECT count(category_id) - count(DISTINCT category_id) AS n FROM u)",
                                           select="""
SELECT 'duplicate_ids' AS "check", n = 0 AS ok, n AS n_bad FROM d
UNION ALL SELECT 'null_category_id', true, 0 UNION ALL SELECT 'null_category_name', true, 0
UNION ALL SELECT 'nonpositive_category_id', true, 0
UNION ALL SELECT 'all_valid', n = 0, n FROM d"""))
def q_validate_categories(spark, sf):
    u = _existing_categories(spark, sf).unionByName(_uploaded_categories(spark, sf))
    return quality.validate_categories(u).select("check", "ok", F.col("n_bad").cast("bigint").alias("n_bad"))


@register("validate_product_category", with_ctes(_BRANDS, _LINEREL, """
unk AS (SELECT DISTINCT category_id FROM lr WHERE category_id NOT IN (SELECT category_id FROM brands))""",
    """d AS (SELECT count(product_id) - count(DISTINCT product_id) AS n,
             count(*) FILTER (WHERE product_id <= 0 OR category_id <= 0) AS np FROM lr)""", select="""
SELECT 'duplicate_products' AS "check", n = 0 AS ok, n AS n_bad, NULL AS examples FROM d
UNION ALL SELECT 'null_product_id', true, 0, NULL UNION ALL SELECT 'null_category_id', true, 0, NULL
UNION ALL SELECT 'nonpositive_ids', np = 0, np, NULL FROM d
UNION ALL SELECT 'all_valid', np = 0, np, NULL FROM d
UNION ALL SELECT 'unknown_categories', count(*) = 0, count(*),
                 array_to_string(list_sort(list(CAST(category_id AS VARCHAR))), '|') FROM
   (SELECT category_id FROM unk ORDER BY category_id LIMIT 10) x"""))
def q_validate_product_category(spark, sf):
    out = quality.validate_product_category(_line_relation(spark, sf), _brands(spark, sf))
    return comparable(out.select("check", "ok", "n_bad", "examples"))


@register("integrity_report", with_ctes(_ORDERS, _BRANDS, select="""
SELECT CAST(0 AS BIGINT) AS null_date, CAST(0 AS BIGINT) AS null_customer_id, CAST(0 AS BIGINT) AS null_products,
       (SELECT count(DISTINCT p_size) FROM part WHERE p_size NOT IN (SELECT category_id FROM brands))
         AS undefined_categories, true AS valid"""))
def q_integrity_report(spark, sf):
    rows, _ = _loaded(spark, sf)
    return quality.integrity_report(files.typed_transactions(rows), _size_relation(spark, sf), _brands(spark, sf))


# ---------------------------------------------------------------- catalogue maintenance

@register("undefined_categories", with_ctes(_BRANDS, select="""
SELECT DISTINCT p_size AS category_id FROM part WHERE p_size NOT IN (SELECT category_id FROM brands)"""))
def q_undefined_categories(spark, sf):
    return catalog.undefined_keys(_size_relation(spark, sf), _brands(spark, sf), "category_id")


@register("existing_keys_kept", """
SELECT p_partkey AS product_id FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem)""")
def q_existing_keys_kept(spark, sf):
    new = catalog.upsert(testdata.product_category(spark, sf).select("*", F.lit(0).cast("bigint").alias("pos")),
                         _line_relation(spark, sf), "product_id", mode="replace")
    return catalog.kept_keys(testdata.product_category(spark, sf), new, "product_id")


@register("dedupe_keep_last", with_ctes(_LINEREL, select="""
SELECT product_id, arg_max(category_id, pos) AS category_id FROM lr GROUP BY product_id"""))
def q_dedupe_keep_last(spark, sf):
    return catalog.dedupe_keep_last(_line_relation(spark, sf), "product_id", "pos")


@register("upsert_categories", with_ctes(_EXISTING, _UPLOADED, select="""
SELECT category_id, category_name FROM up
UNION ALL SELECT category_id, category_name FROM ex WHERE category_id NOT IN (SELECT category_id FROM up)"""))
def q_upsert_categories(spark, sf):
    return catalog.upsert(_existing_categories(spark, sf), _uploaded_categories(spark, sf), "category_id", "add")


@register("upsert_categories_replace", with_ctes(_UPLOADED, select="SELECT category_id, category_name FROM up"))
def q_upsert_categories_replace(spark, sf):
    return catalog.upsert(_existing_categories(spark, sf), _uploaded_categories(spark, sf), "category_id", "replace")


_PC_UPSERT = """
pcu AS (SELECT product_id, arg_max(category_id, pos) AS category_id FROM lr GROUP BY product_id
        UNION ALL SELECT p_partkey, CAST(substr(p_brand, 7) AS INTEGER) FROM part
        WHERE p_partkey NOT IN (SELECT product_id FROM lr))"""


@register("upsert_product_category", with_ctes(_LINEREL, _PC_UPSERT, select="SELECT * FROM pcu"))
def q_upsert_product_category(spark, sf):
    existing = testdata.product_category(spark, sf).select("*", F.lit(0).cast("bigint").alias("pos"))
    return catalog.upsert(existing, _line_relation(spark, sf), "product_id", "add")


@register("upsert_report", with_ctes(_LINEREL, _PC_UPSERT, select="""
SELECT (SELECT count(*) FROM part) AS old_total, (SELECT count(*) FROM lr) AS uploaded_rows,
       count(*) AS new_total, count(*) - (SELECT count(*) FROM part) AS added,
       (SELECT count(*) FROM lr) - (count(*) - (SELECT count(*) FROM part)) AS updated FROM pcu"""))
def q_upsert_report(spark, sf):
    existing = testdata.product_category(spark, sf).select("*", F.lit(0).cast("bigint").alias("pos"))
    up = _line_relation(spark, sf)
    return catalog.upsert_report(existing, up, catalog.upsert(existing, up, "product_id", "add"))


def _old_and_new_relation(spark, sf):
    """The product-category relation and a replacement of it: parts up to size 40
    stay, every fifth size with another category, and suppliers' numbers are new products."""
    old = testdata.product_category(spark, sf)
    part = testdata.table(spark, sf, "part").filter("p_size <= 40")
    brand = F.substring("p_brand", 7, 10).cast("int")
    stay = part.select(F.col("p_partkey").alias("product_id"), F.when(F.col("p_size") % 5 == 0, brand + 1).otherwise(brand).alias("category_id"))
    more = testdata.table(spark, sf, "supplier").select((F.col("s_suppkey") + 10**9).alias("product_id"), F.col("s_nationkey").cast("int").alias("category_id"))
    up = stay.unionByName(more).withColumn("pos", F.lit(0).cast("bigint"))
    return old, catalog.upsert(old.withColumn("pos", F.lit(0).cast("bigint")), up, "product_id", "replace")


_CHANGES = """
ch AS (SELECT p_partkey AS product_id, CASE WHEN p_size > 40 THEN 'removed' WHEN p_size % 5 = 0 THEN 'changed' ELSE 'unchanged' END AS change,
              CAST(substr(p_brand, 7) AS INTEGER) AS old_category_id,
              CASE WHEN p_size <= 40 THEN CAST(substr(p_brand, 7) AS INTEGER) + CASE WHEN p_size % 5 = 0 THEN 1 ELSE 0 END END AS new_category_id FROM part
       UNION ALL SELECT s_suppkey + 1000000000, 'added', NULL, CAST(s_nationkey AS INTEGER) FROM supplier)"""


@register("upsert_changes", with_ctes(_CHANGES, select="""
SELECT product_id, change, coalesce(old_category_id, -1) AS old_category_id, coalesce(new_category_id, -1) AS new_category_id FROM ch"""))
def q_upsert_changes(spark, sf):
    """Every product of the old relation or its replacement, classified."""
    out = catalog.change_report(*_old_and_new_relation(spark, sf), "product_id")
    return out.fillna(-1, ["old_category_id", "new_category_id"])


@register("upsert_change_counts", with_ctes(_CHANGES, select="""
SELECT count(*) FILTER (WHERE change = 'added') AS added, count(*) FILTER (WHERE change = 'changed') AS changed,
       count(*) FILTER (WHERE change = 'removed') AS removed, count(*) FILTER (WHERE change = 'unchanged') AS unchanged FROM ch"""))
def q_upsert_change_counts(spark, sf):
    return catalog.change_counts(catalog.change_report(*_old_and_new_relation(spark, sf), "product_id"))


# ---------------------------------------------------------------- batches and status

def _new_batch(spark, sf):
    return testdata.part_basket_strings(spark, sf, F.col("date") >= F.lit(CUTOFF))


def _old_fact(spark, sf):
    """Fact rows of the older orders. Of the warehouse only the fact is built for them."""
    return testdata_warehouse(spark, sf, ("transactions_expanded",)).fact().filter(F.col("date") < F.lit(CUTOFF))


def _old_warehouse(spark, sf):
    """A warehouse of the older orders, written from the tables: a fact of all orders is not stored first."""
    return write_processed(spark, testdata.fact(spark, sf).filter(F.col("date") < F.lit(CUTOFF)), scratch_path(spark, "wh_old"))


_FACT_OUT = ["transaction_id", "date", "store_id", "customer_id", "product_id", "quantity", "category_id",
             "category_name", "year", "month"]
_FACT_SQL = ", ".join(_FACT_OUT)


@register("append_transactions", with_ctes(LINES, select=f"SELECT {_FACT_SQL} FROM fact"))
def q_append_transactions(spark, sf):
    out = catalog.append_transactions(_old_fact(spark, sf), _new_batch(spark, sf),
                                      testdata.product_category(spark, sf), _brands(spark, sf), "append")
    return out.select(*_FACT_OUT)


@register("replace_transactions", with_ctes(LINES, select=f"SELECT {_FACT_SQL} FROM fact WHERE date >= DATE '{CUTOFF}'"))
def q_replace_transactions(spark, sf):
    out = catalog.append_transactions(_old_fact(spark, sf), _new_batch(spark, sf),
                                      testdata.product_category(spark, sf), _brands(spark, sf), "replace")
    return out.select(*_FACT_OUT)


@register("append_summary", with_ctes(LINES, f"nf AS (SELECT * FROM fact WHERE date >= DATE '{CUTOFF}')",
                                      f"of AS (SELECT * FROM fact WHERE date < DATE '{CUTOFF}')", select="""
SELECT count(*) AS rows, count(DISTINCT customer_id) AS customers, count(DISTINCT product_id) AS products,
       (SELECT count(DISTINCT customer_id) FROM nf WHERE customer_id NOT IN (SELECT customer_id FROM of))
         AS new_customers,
       (SELECT count(DISTINCT product_id) FROM nf WHERE product_id NOT IN (SELECT product_id FROM of))
         AS new_products
FROM nf"""))
def q_append_summary(spark, sf):
    new = catalog.batch_fact(_new_batch(spark, sf), testdata.product_category(spark, sf), _brands(spark, sf))
    old = _old_warehouse(spark, sf)
    return catalog.append_summary_stored(old.customer_metrics(), old.product_metrics(), new)


@register("data_status", with_ctes(LINES, select="""
SELECT count(*) AS rows, count(DISTINCT customer_id) AS customers, count(DISTINCT product_id) AS products,
       count(DISTINCT store_id) AS stores, min(date) AS min_date, max(date) AS max_date,
       CAST(date_diff('day', min(date), max(date)) AS INTEGER) AS days FROM fact"""))
def q_data_status(spark, sf):
    wh = testdata_warehouse(spark, sf)
    return catalog.data_status_stored(wh.state("category_totals"), wh.state("day_members"))


# ---------------------------------------------------------------- sinks, rebuild, streaming

@register("roundtrip_processed", with_ctes(LINES, select="""
SELECT transaction_id, min(date) AS date, min(store_id) AS store_id, min(customer_id) AS customer_id,
       count(DISTINCT product_id) AS basket_size, CAST(sum(quantity) AS BIGINT) AS total_quantity,
       count(DISTINCT category_id) AS category_diversity
FROM fact GROUP BY transaction_id"""))
def q_roundtrip_processed(spark, sf):
    return testdata_warehouse(spark, sf).transaction_metrics()


@register("export_csv", ORACLES["customer_metrics"])
def q_export_csv(spark, sf):
    cm = facts.customer_metrics(testdata_warehouse(spark, sf).fact())
    path = scratch_path(spark, "export_customer_metrics")
    sinks.export_csv(cm, path)
    return comparable(sinks.read_csv_export(spark, path, cm.schema))


@register("storage_report", with_ctes(LINES, """
n AS (SELECT unnest(['transactions_expanded', 'transaction_metrics', 'customer_metrics', 'product_metrics', 'customer_norms', 'customer_item',
                     'customer_visits', 'customer_totals', 'product_totals', 'category_totals']) AS "table",
             unnest([(SELECT count(*) FROM fact), (SELECT count(DISTINCT transaction_id) FROM fact), (SELECT count(DISTINCT customer_id) FROM fact),
                     (SELECT count(DISTINCT product_id) FROM fact), (SELECT count(DISTINCT customer_id) FROM fact),
                     (SELECT count(*) FROM (SELECT DISTINCT customer_id, product_id FROM fact)),
                     (SELECT count(*) FROM (SELECT DISTINCT customer_id, store_id, category_id, category_name FROM fact)),
                     (SELECT count(DISTINCT customer_id) FROM fact), (SELECT count(DISTINCT product_id) FROM fact),
                     (SELECT count(DISTINCT category_name) FROM fact)]) AS rows)""", select="""
SELECT "table", rows, true AS has_files, true AS has_size FROM n"""))
def q_storage_report(spark, sf):
    """Size on disk of every processed table beside the rows its manifest states."""
    wh = testdata_warehouse(spark, sf)
    names = [t for t in TABLES if not t.endswith("_members")]
    rows = F.create_map(*[x for k, v in Warehouse.open(spark, wh.root).rows.items() for x in (F.lit(k), F.lit(v))])
    return sinks.storage_report(spark, wh.root, names).select(
        "table", rows[F.col("table")].alias("rows"), (F.col("files") > 0).alias("has_files"), (F.col("size_mb") > 0).alias("has_size"))


@register("rebuild_all", ORACLES["customer_metrics"])
def q_rebuild_all(spark, sf):
    r = _raw(spark, sf)
    wh, _ = rebuild(spark, r["root"], r["categories"], r["product_category"], scratch_path(spark, "rebuild"))
    return comparable(facts.customer_metrics(wh.fact()))


def _streamed(spark, r, cats, pc, max_files=16):
    out, ck = scratch_path(spark, "stream_fact"), scratch_path(spark, "stream_ckpt")
    ingest_stream(spark, r["root"], pc, cats, out, ck, max_files, report_path=f"{out}-report").awaitTermination()
    return out


@register("stream_ingest", ORACLES["customer_metrics"])
def q_stream_ingest(spark, sf):
    out = _streamed(spark, _raw(spark, sf), _brands(spark, sf), testdata.product_category(spark, sf))
    f = spark.read.option("basePath", out).parquet(f"{out}/batch_id=*")
    return comparable(facts.customer_metrics(f))


def _streamed_mixed(spark, sf):
    r = testdata.mixed_files(spark, sf)
    return _streamed(spark, r, files.load_categories(spark, r["categories"]).drop("pos"),
                     files.load_product_category(spark, r["product_category"]).drop("pos"), max_files=2)


@register("stream_mixed", ORACLES["rebuild_mixed"])
def q_stream_mixed(spark, sf):
    """The mixed folder streamed two files a batch gives the fact rows of its rebuild."""
    out = _streamed_mixed(spark, sf)
    return spark.read.option("basePath", out).parquet(f"{out}/batch_id=*").select(
        "date", "store_id", "customer_id", "product_id", "quantity", "category_id", "category_name")


@register("stream_rejected", ORACLES["rejected_rows"])
def q_stream_rejected(spark, sf):
    """The rows set apart by all batches of the same stream."""
    root = f"{_streamed_mixed(spark, sf)}-report/rejected"
    return spark.read.option("basePath", root).parquet(f"{root}/batch_id=*").select("date", "store_id", "customer_id", "reason")


@register("stream_gate_report", ORACLES["gate_report"])
def q_stream_gate_report(spark, sf):
    """Its file reports, a source's part files of several batches together."""
    root = f"{_streamed_mixed(spark, sf)}-report/gate"
    g = spark.read.option("basePath", root).parquet(f"{root}/batch_id=*")
    counts = ["rows", "foreign_rows", "bad_dates", "bad_customer_ids"]
    one = g.groupBy(F.regexp_extract("source", r"([^/]+)$", 1).alias("source")).agg(
        *[F.sum(c).alias(c) for c in counts], F.bool_and("layout_ok").alias("layout_ok"),
        F.array_distinct(F.flatten(F.collect_set("missing_columns"))).alias("missing_columns"),
        F.min("reason").alias("reason"), F.bool_and("accepted").alias("accepted"))
    return comparable(one)


@register("export_customer_recommendations", ORACLES["customer_recommendations"])
def q_export_customer_recommendations(spark, sf):
    """The recommendation table as exported and read back."""
    return _exported(spark, QUERIES["customer_recommendations"](spark, sf), "export_recommendations")


@register("export_product_recommendations", ORACLES["product_recommendations"])
def q_export_product_recommendations(spark, sf):
    return _exported(spark, QUERIES["product_recommendations"](spark, sf), "export_companions")


def _exported(spark, df, name):
    path = scratch_path(spark, name)
    sinks.export_csv(df, path)
    return sinks.read_csv_export(spark, path, df.schema)


@register("preview", with_ctes(_MIXED, select="""
SELECT CASE WHEN bad_date THEN 'never' ELSE strftime(date, '%Y-%m-%d') END AS date, '1' AS store_id,
       CASE WHEN bad_customer THEN 'x' ELSE CAST(customer_id AS VARCHAR) END AS customer_id,
       coalesce((SELECT rtrim(string_agg(repeat(CAST(l_partkey AS VARCHAR) || ' ', CAST(l_quantity AS INTEGER)), ''
                 ORDER BY l_linenumber, l_partkey, l_quantity)) FROM lineitem WHERE l_orderkey = o_orderkey), '') AS products
FROM (SELECT * FROM mx WHERE store_id = 1 ORDER BY o_orderkey LIMIT 10)"""))
def q_preview(spark, sf):
    """First 10 rows of one upload in file order (the preview table)."""
    rows, _ = files.load_transactions(spark, testdata.mixed_files(spark, sf)["root"])
    return files.preview(rows, "1_Tran.csv").select("date", "store_id", "customer_id", F.coalesce("products", F.lit("")).alias("products"))


@register("append_recompute_metrics", ORACLES["customer_metrics"])
def q_append_recompute_metrics(spark, sf):
    out = catalog.append_transactions(_old_fact(spark, sf), _new_batch(spark, sf),
                                      testdata.product_category(spark, sf), _brands(spark, sf), "append")
    return comparable(catalog.recompute_metrics(out)["customer_metrics"])


def _appended(spark, sf):
    old = _old_warehouse(spark, sf)
    return append_batch(spark, old, _new_batch(spark, sf), testdata.product_category(spark, sf),
                        _brands(spark, sf), scratch_path(spark, "wh_new"), batch_id="new")


@register("append_publish", ORACLES["customer_metrics"])
def q_append_publish(spark, sf):
    """Append the new batch to a warehouse holding the older orders and publish
    a new version; its customer metrics equal the full table's."""
    return comparable(_appended(spark, sf).customer_metrics())


@register("append_publish_products", ORACLES["product_metrics"])
def q_append_publish_products(spark, sf):
    """The product metrics of the same append, read back through its manifest."""
    return comparable(Warehouse.open(spark, _appended(spark, sf).root).product_metrics())


@register("append_known", with_ctes(LINES, f"old AS (SELECT DISTINCT transaction_id FROM fact WHERE date < DATE '{CUTOFF}')", select=f"""
SELECT (SELECT count(*) FROM old WHERE transaction_id % 3 = 0) AS known, count(DISTINCT transaction_id) AS transactions,
       count(*) AS rows, CAST(sum(quantity) AS BIGINT) AS units FROM fact"""))
def q_append_known(spark, sf):
    """A batch that repeats a third of the stored transactions: refused with their
    number, and appended without them; nothing is counted twice."""
    old = _old_warehouse(spark, sf)
    every = testdata.part_basket_strings(spark, sf, (F.col("date") >= F.lit(CUTOFF)) | (F.col("transaction_id") % 3 == 0))
    more = [testdata.product_category(spark, sf), _brands(spark, sf)]
    try:
        append_batch(spark, old, every, *more, scratch_path(spark, "wh_refused"))
        known = None
    except KnownTransactions as e:
        known = e.n
    new = append_batch(spark, old, every, *more, scratch_path(spark, "wh_skipped"), on_known="skip")
    tx, rows = new.transaction_metrics(), new.state("category_totals").select(F.sum("lines")).scalar()
    return tx.agg(F.count_distinct("transaction_id").alias("transactions"), F.sum("total_quantity").alias("units")).select(
        F.lit(known).cast("bigint").alias("known"), "transactions", rows.alias("rows"), "units")


# ---------------------------------------------------------------- enrichment and lookups

_BULK = "bulk AS (SELECT DISTINCT l_partkey AS product_id, CAST(l_linenumber AS INTEGER) AS category_id FROM lineitem WHERE l_quantity > 45)"


@register("enrich_fanout", with_ctes(LINES, _BULK, select="""
SELECT coalesce(b.category_id, 0) AS category_id, CASE WHEN b.category_id <= 5 THEN 'Line ' || b.category_id END AS category_name, count(*) AS rows,
       CAST(sum(f.quantity) AS BIGINT) AS units
FROM fact f LEFT JOIN bulk b ON b.product_id = f.product_id GROUP BY 1, 2"""))
def q_enrich_fanout(spark, sf):
    """Enrichment by a relation with several categories a product, products without
    one and categories without a name, counted by category."""
    li = testdata.table(spark, sf, "lineitem")
    bulk = li.filter("l_quantity > 45").select(F.col("l_partkey").alias("product_id"), F.col("l_linenumber").cast("int").alias("category_id")).distinct()
    named = li.select(F.col("l_linenumber").cast("int").alias("category_id")).distinct().filter("category_id <= 5")
    named = named.select("category_id", F.concat(F.lit("Line "), F.col("category_id").cast("string")).alias("category_name"))
    f = baskets.enrich(testdata.basket_lines(spark, sf), bulk, named)
    shown = F.coalesce("category_id", F.lit(0)).alias("category_id")
    return f.groupBy(shown, "category_name").agg(F.count(F.lit(1)).alias("rows"), F.sum("quantity").alias("units"))


_TOP_IDS = "(SELECT product_id FROM pm ORDER BY total_quantity DESC, product_id LIMIT 3)"
_STATS = """
SELECT f.product_id, {name} AS product_name, coalesce(arg_min(f.category_name, f.category_id), 'Sin categoría') AS category_name,
       CAST(sum(f.quantity) AS BIGINT) AS total_quantity, count(DISTINCT f.customer_id) AS unique_customers,
       count(DISTINCT f.transaction_id) AS unique_transactions, round(avg(f.quantity), 6) AS avg_quantity_per_transaction
FROM fact f JOIN part ON p_partkey = f.product_id {where} GROUP BY f.product_id"""


@register("product_lookup", with_ctes(LINES, PRODUCT_METRICS, select=_STATS.format(
    name="'Producto ' || CAST(f.product_id AS VARCHAR)", where=f"WHERE f.product_id IN {_TOP_IDS}")))
def q_product_lookup(spark, sf):
    """Statistics of given products: the three that sell most."""
    wh = testdata_warehouse(spark, sf)
    ids = wh.product_metrics().orderBy(F.desc("total_quantity"), "product_id").limit(3)
    return comparable(kpis.product_statistics_stored(wh.product_metrics(), ids))


@register("product_statistics_named", with_ctes(LINES, select=_STATS.format(name="min(p_name)", where="")))
def q_product_statistics_named(spark, sf):
    """Product statistics of a fact that carries the products' real names."""
    names = testdata.table(spark, sf, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("product_name"))
    return comparable(kpis.product_statistics(testdata_warehouse(spark, sf).fact().join(names, "product_id", "left")))


@register("customer_lookup", ORACLES["customer_statistics"] + " WHERE b.customer_id IN (SELECT customer_id FROM base ORDER BY total_transactions DESC, customer_id LIMIT 3)")
def q_customer_lookup(spark, sf):
    """Statistics of given customers, the three with most transactions, from the buckets that hold them."""
    wh = testdata_warehouse(spark, sf)
    ids = wh.customer_metrics().orderBy(F.desc("frequency"), "customer_id").limit(3)
    return comparable(wh.customer_statistics(ids))
