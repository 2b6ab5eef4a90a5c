"""DuckDB SQL building blocks mirroring the testdata mapping."""

LINES = """
lines AS (
  SELECT o.o_orderkey AS transaction_id,
         CAST(o.o_orderdate AS DATE) AS date,
         CAST(substr(o.o_orderpriority, 1, 1) AS INTEGER) AS store_id,
         o.o_custkey AS customer_id,
         l.l_partkey AS product_id,
         CAST(sum(l.l_quantity) AS BIGINT) AS quantity
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  GROUP BY 1, 2, 3, 4, 5
),
pc AS (SELECT p_partkey AS product_id, CAST(substr(p_brand, 7) AS INTEGER) AS category_id FROM part),
cats AS (SELECT DISTINCT CAST(substr(p_brand, 7) AS INTEGER) AS category_id, p_brand AS category_name FROM part),
fact AS (
  SELECT x.transaction_id, x.date, x.store_id, x.customer_id, x.product_id, x.quantity,
         pc.category_id, cats.category_name,
         CAST(year(x.date) AS INTEGER) AS year, CAST(month(x.date) AS INTEGER) AS month,
         CAST(day(x.date) AS INTEGER) AS day, CAST(isodow(x.date) - 1 AS INTEGER) AS day_of_week,
         dayname(x.date) AS day_name, CAST(weekofyear(x.date) AS INTEGER) AS week_of_year,
         CASE WHEN isodow(x.date) >= 6 THEN 1 ELSE 0 END AS is_weekend,
         CAST(quarter(x.date) AS INTEGER) AS quarter
  FROM lines x LEFT JOIN pc ON x.product_id = pc.product_id
  LEFT JOIN cats ON pc.category_id = cats.category_id
)"""

PER_TX = """
per_tx AS (
  SELECT transaction_id, count(DISTINCT product_id) AS unique_products,
         CAST(sum(quantity) AS BIGINT) AS total_quantity,
         count(DISTINCT category_id) AS unique_categories
  FROM fact GROUP BY transaction_id
)"""

CUSTOMER_METRICS = """
cm_base AS (
  SELECT customer_id, count(DISTINCT transaction_id) AS frequency, max(date) AS last_purchase_date,
         CAST(sum(quantity) AS BIGINT) AS total_quantity, count(DISTINCT product_id) AS unique_products,
         count(DISTINCT category_id) AS unique_categories
  FROM fact GROUP BY customer_id
),
store_rank AS (
  SELECT customer_id, store_id,
         row_number() OVER (PARTITION BY customer_id ORDER BY count(*) DESC, store_id) AS rn
  FROM fact GROUP BY customer_id, store_id
),
cm AS (
  SELECT b.*, s.store_id AS preferred_store,
         CAST(date_diff('day', b.last_purchase_date, (SELECT max(date) FROM fact)) AS INTEGER) AS recency,
         b.total_quantity / b.frequency AS avg_basket_size,
         b.unique_categories / b.frequency AS category_diversity_score
  FROM cm_base b JOIN store_rank s ON b.customer_id = s.customer_id AND s.rn = 1
)"""

PRODUCT_METRICS = """
pm AS (
  SELECT product_id, count(DISTINCT transaction_id) AS product_frequency,
         count(DISTINCT customer_id) AS unique_customers,
         CAST(sum(quantity) AS BIGINT) AS total_quantity, avg(quantity) AS avg_quantity,
         min(category_id) AS category_id,
         arg_min(category_name, category_id) AS category_name
  FROM fact GROUP BY product_id
)"""


def with_ctes(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n" + select
