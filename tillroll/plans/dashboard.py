"""Registered checks: fact tables, KPIs, summaries, time series, top-N, statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillroll.operators import baskets, facts, kpis, stats, temporal, topk
from tillroll.plans.oracle_sql import CUSTOMER_METRICS, LINES, PER_TX, PRODUCT_METRICS, with_ctes
from tillroll.plans.registry import comparable, register
from tillroll.plans.warehouse import testdata_warehouse
from tillroll.sources import testdata


def _fact(spark, sf):
    return testdata_warehouse(spark, sf).fact()


def _cm(spark, sf):
    """The processed customer metrics table (written once by the rebuild)."""
    return testdata_warehouse(spark, sf, ["customer_metrics"]).customer_metrics()


def _pm(spark, sf):
    return testdata_warehouse(spark, sf).product_metrics()


def _tx(spark, sf):
    return testdata_warehouse(spark, sf).transaction_metrics()


def _state(spark, sf, name):
    return testdata_warehouse(spark, sf).state(name)


def _ci(spark, sf):
    return testdata_warehouse(spark, sf).customer_item()


# ---------------------------------------------------------------- fact tables

@register("customer_metrics", with_ctes(LINES, CUSTOMER_METRICS, select="""
SELECT customer_id, frequency, last_purchase_date, total_quantity, unique_products, unique_categories,
       preferred_store, recency, round(avg_basket_size, 6) AS avg_basket_size,
       round(category_diversity_score, 6) AS category_diversity_score FROM cm"""))
def q_customer_metrics(spark, sf):
    return comparable(facts.customer_metrics_stored(_state(spark, sf, "customer_totals"), _ci(spark, sf), _state(spark, sf, "customer_visits")))


@register("transaction_metrics", with_ctes(LINES, select="""
SELECT transaction_id, min(date) AS date, min(store_id) AS store_id, min(customer_id) AS customer_id,
       count(DISTINCT product_id) AS basket_size, CAST(sum(quantity) AS BIGINT) AS total_quantity,
       count(DISTINCT category_id) AS category_diversity
FROM fact GROUP BY transaction_id"""))
def q_transaction_metrics(spark, sf):
    return comparable(facts.transaction_metrics(_fact(spark, sf)))


@register("product_metrics", with_ctes(LINES, PRODUCT_METRICS, select="""
SELECT product_id, product_frequency, unique_customers, total_quantity, round(avg_quantity, 6) AS avg_quantity,
       category_id, category_name FROM pm"""))
def q_product_metrics(spark, sf):
    return comparable(facts.product_metrics(_fact(spark, sf)))


@register("temporal_features", with_ctes(LINES, select="""
SELECT transaction_id, product_id, date, year, month, day, day_of_week, day_name, week_of_year,
       is_weekend, quarter FROM fact"""))
def q_temporal_features(spark, sf):
    lines = testdata.basket_lines(spark, sf)
    return baskets.add_calendar(lines).select(
        "transaction_id", "product_id", "date", "year", "month", "day", "day_of_week", "day_name",
        "week_of_year", "is_weekend", "quarter")


@register("enrich_categories", with_ctes(LINES, select="""
SELECT transaction_id, product_id, quantity, category_id, category_name FROM fact"""))
def q_enrich_categories(spark, sf):
    f = baskets.enrich(testdata.basket_lines(spark, sf), testdata.product_category(spark, sf),
                       testdata.categories(spark, sf))
    return f.select("transaction_id", "product_id", "quantity", "category_id", "category_name")


@register("missing_category", with_ctes(LINES, select="""
SELECT count(*) AS total_rows, count(*) FILTER (WHERE category_id IS NULL) AS missing_rows,
       round(100.0 * count(*) FILTER (WHERE category_id IS NULL) / count(*), 6) AS missing_pct FROM fact"""))
def q_missing_category(spark, sf):
    return comparable(baskets.missing_category_report(_fact(spark, sf)))


@register("expand_baskets", """
SELECT l.l_orderkey AS transaction_id, CAST(substr(p.p_brand, 7) AS BIGINT) AS product_id,
       count(*) AS quantity
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
GROUP BY 1, 2""")
def q_expand_baskets(spark, sf):
    return baskets.expand_baskets(testdata.basket_strings(spark, sf)) \
                  .select("transaction_id", "product_id", "quantity")


# ---------------------------------------------------------------- KPIs and summaries

_KPI_SELECT = """
SELECT CAST(sum(quantity) AS BIGINT) AS total_units,
       (SELECT count(*) FROM per_tx) AS total_transactions,
       count(DISTINCT customer_id) AS total_customers, count(DISTINCT product_id) AS total_products,
       count(DISTINCT category_id) AS total_categories, count(DISTINCT store_id) AS total_stores,
       (SELECT round(avg(unique_products), 6) FROM per_tx) AS avg_basket_size,
       (SELECT round(avg(total_quantity), 6) FROM per_tx) AS avg_units_per_transaction,
       min(date) AS start_date, max(date) AS end_date,
       CAST(date_diff('day', min(date), max(date)) AS INTEGER) AS days
FROM fact"""


@register("kpis", with_ctes(LINES, PER_TX, select=_KPI_SELECT))
def q_kpis(spark, sf):
    return comparable(kpis.kpis_stored(_tx(spark, sf), _state(spark, sf, "day_members")))


FILTER = dict(date_range=("1996-01-01", "1998-06-30"), store=2, category="Brand#13")
_FILTERED = """
fact AS (SELECT * FROM fact0 WHERE date BETWEEN DATE '1996-01-01' AND DATE '1998-06-30'
         AND store_id = 2 AND category_name = 'Brand#13')"""


@register("filtered_kpis", with_ctes(LINES.replace("\nfact AS (", "\nfact0 AS ("), _FILTERED, PER_TX,
                                     select=_KPI_SELECT))
def q_filtered_kpis(spark, sf):
    return comparable(kpis.kpis(baskets.apply_filters(_fact(spark, sf), **FILTER)))


@register("kpis_of_dates_and_store", with_ctes(LINES.replace("\nfact AS (", "\nfact0 AS ("),
                                               _FILTERED.replace(" AND category_name = 'Brand#13'", ""), PER_TX, select=_KPI_SELECT))
def q_kpis_of_dates_and_store(spark, sf):
    """The dashboard's figures for a date range and store, without the fact."""
    cut = lambda df: baskets.apply_filters(df, FILTER["date_range"], FILTER["store"])
    return comparable(kpis.kpis_stored(cut(_tx(spark, sf)), cut(_state(spark, sf, "day_members"))))


@register("filter_options", with_ctes(LINES, select="""
SELECT min(date) AS min_date, max(date) AS max_date,
       array_to_string(list_sort(list(DISTINCT CAST(store_id AS VARCHAR))), '|') AS stores,
       array_to_string(list_sort(list(DISTINCT category_name) FILTER (WHERE category_name IS NOT NULL)), '|')
         AS categories
FROM fact"""))
def q_filter_options(spark, sf):
    return comparable(baskets.filter_options(_fact(spark, sf)))


_GROUP_COUNTS = """
SELECT {key}, CAST(sum(quantity) AS BIGINT) AS total_units, count(DISTINCT transaction_id) AS transactions,
       count(DISTINCT customer_id) AS customers, count(DISTINCT product_id) AS products
FROM fact {where} GROUP BY {key}"""


@register("category_performance", with_ctes(
    LINES, "g AS (" + _GROUP_COUNTS.format(key="category_name", where="WHERE category_name IS NOT NULL") + ")",
    select="SELECT *, round(total_units * 100.0 / (SELECT sum(total_units) FROM g), 6) AS percentage FROM g"))
def q_category_performance(spark, sf):
    return comparable(kpis.category_performance_stored(_state(spark, sf, "category_totals"), _state(spark, sf, "category_members")))


@register("store_performance", with_ctes(
    LINES, "g AS (" + _GROUP_COUNTS.format(key="store_id", where="") + ")",
    select="""SELECT *, round(total_units / transactions, 6) AS avg_basket_size,
                     round(transactions / customers, 6) AS avg_transactions_per_customer FROM g"""))
def q_store_performance(spark, sf):
    return comparable(kpis.store_performance_stored(_tx(spark, sf), _state(spark, sf, "day_members")))


@register("product_statistics", with_ctes(LINES, select="""
SELECT product_id, 'Producto ' || CAST(product_id AS VARCHAR) AS product_name,
       coalesce(arg_min(category_name, category_id), 'Sin categoría') AS category_name,
       CAST(sum(quantity) AS BIGINT) AS total_quantity, count(DISTINCT customer_id) AS unique_customers,
       count(DISTINCT transaction_id) AS unique_transactions,
       round(avg(quantity), 6) AS avg_quantity_per_transaction
FROM fact GROUP BY product_id"""))
def q_product_statistics(spark, sf):
    return comparable(kpis.product_statistics_stored(_pm(spark, sf)))


@register("customer_statistics", with_ctes(LINES, """
base AS (SELECT customer_id, count(DISTINCT transaction_id) AS total_transactions,
                CAST(sum(quantity) AS BIGINT) AS total_quantity, count(DISTINCT product_id) AS unique_products,
                count(DISTINCT category_name) AS unique_categories, count(*) AS n_rows
         FROM fact GROUP BY customer_id)""", """
fav AS (SELECT customer_id, category_name,
               row_number() OVER (PARTITION BY customer_id ORDER BY sum(quantity) DESC, category_name) AS rn
        FROM fact WHERE category_name IS NOT NULL GROUP BY customer_id, category_name)""", select="""
SELECT b.customer_id, total_transactions, total_quantity, unique_products, unique_categories,
       f.category_name AS favorite_category, round(n_rows / total_transactions, 6) AS avg_products_per_transaction
FROM base b LEFT JOIN fav f ON b.customer_id = f.customer_id AND f.rn = 1"""))
def q_customer_statistics(spark, sf):
    return comparable(testdata_warehouse(spark, sf).customer_statistics())


@register("segmentation_summary", with_ctes(LINES, CUSTOMER_METRICS, select="""
SELECT count(*) AS total_customers, round(avg(frequency), 6) AS avg_frequency,
       round(avg(recency), 6) AS avg_recency, round(avg(total_quantity), 6) AS avg_total_quantity,
       count(*) FILTER (WHERE frequency <= 2) AS freq_low,
       count(*) FILTER (WHERE frequency > 2 AND frequency <= 10) AS freq_medium,
       count(*) FILTER (WHERE frequency > 10 AND frequency <= 50) AS freq_high,
       count(*) FILTER (WHERE frequency > 50) AS freq_very_high,
       count(*) FILTER (WHERE recency <= 30) AS recency_recent,
       count(*) FILTER (WHERE recency > 30 AND recency <= 90) AS recency_moderate,
       count(*) FILTER (WHERE recency > 90) AS recency_old
FROM cm"""))
def q_segmentation_summary(spark, sf):
    return comparable(kpis.segmentation_summary(_cm(spark, sf)))


@register("product_penetration", with_ctes(LINES, PRODUCT_METRICS, select="""
SELECT product_id, product_frequency, unique_customers, total_quantity, round(avg_quantity, 6) AS avg_quantity,
       category_id, category_name,
       round(unique_customers * 100.0 / (SELECT count(DISTINCT customer_id) FROM fact), 6) AS penetration,
       round(product_frequency / unique_customers, 6) AS avg_frequency
FROM pm"""))
def q_product_penetration(spark, sf):
    total = _cm(spark, sf).select(F.count("customer_id")).scalar()
    return comparable(kpis.product_penetration(_pm(spark, sf), total))


@register("basket_analysis", with_ctes(LINES, PER_TX, select="""
SELECT round(avg(unique_products), 6) AS avg_products_per_basket,
       round(quantile_cont(unique_products, 0.5), 6) AS median_products_per_basket,
       round(avg(total_quantity), 6) AS avg_quantity_per_basket,
       round(quantile_cont(total_quantity, 0.5), 6) AS median_quantity_per_basket,
       round(avg(unique_categories), 6) AS avg_categories_per_basket
FROM per_tx"""))
def q_basket_analysis(spark, sf):
    return comparable(kpis.basket_analysis(_tx(spark, sf)))


@register("basket_size_distribution", with_ctes(LINES, PER_TX, select="""
SELECT unique_products, count(*) AS transactions FROM per_tx GROUP BY unique_products"""))
def q_basket_size_distribution(spark, sf):
    return kpis.basket_size_distribution(_tx(spark, sf))


@register("daily_stats", with_ctes(LINES, select="""
SELECT date, count(DISTINCT transaction_id) AS transactions, CAST(sum(quantity) AS BIGINT) AS total_units
FROM fact GROUP BY date"""))
def q_daily_stats(spark, sf):
    return kpis.daily_stats(_tx(spark, sf))


DESCRIBE_COLUMNS = ["frequency", "total_quantity", "unique_products", "unique_categories", "recency",
                    "avg_basket_size", "category_diversity_score"]


def _describe_sql():
    parts = []
    for c in DESCRIBE_COLUMNS:
        x = f"CAST({c} AS DOUBLE)"
        parts.append(f"""SELECT '{c}' AS "column", count({x}) AS count, round(avg({x}), 6) AS mean,
            round(stddev_samp({x}), 6) AS std, round(min({x}), 6) AS min,
            round(quantile_cont({x}, 0.25), 6) AS q25, round(quantile_cont({x}, 0.5), 6) AS q50,
            round(quantile_cont({x}, 0.75), 6) AS q75, round(max({x}), 6) AS max FROM cm""")
    return "\nUNION ALL\n".join(parts)


@register("describe_customers", with_ctes(LINES, CUSTOMER_METRICS, select=_describe_sql()))
def q_describe_customers(spark, sf):
    return comparable(kpis.describe(_cm(spark, sf), DESCRIBE_COLUMNS))


@register("category_volume_top5", with_ctes(LINES, select="""
SELECT category_name, CAST(sum(quantity) AS BIGINT) AS total_units FROM fact
WHERE category_name IS NOT NULL GROUP BY category_name ORDER BY total_units DESC, category_name LIMIT 5"""))
def q_category_volume_top5(spark, sf):
    return kpis.category_volume_top(_fact(spark, sf), 5)


@register("active_customers", with_ctes(LINES, CUSTOMER_METRICS, select="""
SELECT customer_id, frequency FROM cm WHERE frequency >= 5"""))
def q_active_customers(spark, sf):
    return kpis.active_customers(_cm(spark, sf)).select("customer_id", "frequency")


# ---------------------------------------------------------------- time series and patterns

_LABEL = {"d": "date", "w": "CAST(date_trunc('week', date) AS DATE) + 6", "m": "last_day(date)"}
_STEP = {"d": "INTERVAL 1 DAY", "w": "INTERVAL 7 DAY", "m": "INTERVAL 1 MONTH"}
_VALUE = {"units": "CAST(sum(quantity) AS BIGINT)", "transactions": "count(DISTINCT transaction_id)",
          "customers": "count(DISTINCT customer_id)"}


def _spine_sql(freq):
    if freq == "m":
        return """spine AS (SELECT CAST(last_day(CAST(s AS DATE)) AS DATE) AS period FROM
          (SELECT unnest(generate_series(CAST(date_trunc('month', min(period)) AS TIMESTAMP),
                         CAST(date_trunc('month', max(period)) AS TIMESTAMP), INTERVAL 1 MONTH)) AS s FROM per))"""
    return f"""spine AS (SELECT CAST(s AS DATE) AS period FROM
          (SELECT unnest(generate_series(CAST(min(period) AS TIMESTAMP), CAST(max(period) AS TIMESTAMP),
                         {_STEP[freq]})) AS s FROM per))"""


def _series_sql(freq, metric):
    per = f"per AS (SELECT {_LABEL[freq]} AS period, {_VALUE[metric]} AS value FROM fact GROUP BY 1)"
    return with_ctes(LINES, per, _spine_sql(freq), select="""
SELECT s.period, CAST(coalesce(p.value, 0) AS BIGINT) AS value FROM spine s LEFT JOIN per p ON s.period = p.period""")


def _make_series(freq, metric):
    @register(f"time_series_{freq}_{metric}", _series_sql(freq, metric))
    def q(spark, sf):
        return temporal.time_series(_tx(spark, sf), metric, freq)
    return q


for _f in ("d", "w", "m"):
    for _m in temporal.METRICS:
        _make_series(_f, _m)

_PREV = {"d": "s.period - 1", "w": "s.period - 7", "m": "last_day(s.period - INTERVAL 1 MONTH)"}


def _pct(c):
    return (f"CASE WHEN p.{c} IS NULL THEN NULL WHEN p.{c} = 0 AND s.{c} = 0 THEN NULL "
            f"WHEN p.{c} = 0 THEN CAST('Infinity' AS DOUBLE) "
            f"ELSE round((s.{c} - p.{c}) / CAST(p.{c} AS DOUBLE) * 100.0, 6) END")


def _growth_sql(freq):
    per = (f"per AS (SELECT {_LABEL[freq]} AS period, CAST(sum(quantity) AS BIGINT) AS total_units, "
           "count(DISTINCT transaction_id) AS transactions, count(DISTINCT customer_id) AS customers "
           "FROM fact GROUP BY 1)")
    filled = """filled AS (SELECT s.period, CAST(coalesce(p.total_units, 0) AS BIGINT) AS total_units,
        CAST(coalesce(p.transactions, 0) AS BIGINT) AS transactions,
        CAST(coalesce(p.customers, 0) AS BIGINT) AS customers
        FROM spine s LEFT JOIN per p ON s.period = p.period)"""
    return with_ctes(LINES, per, _spine_sql(freq), filled, select=f"""
SELECT s.period, s.total_units, s.transactions, s.customers,
       {_pct('total_units')} AS units_growth, {_pct('transactions')} AS transactions_growth,
       {_pct('customers')} AS customers_growth
FROM filled s LEFT JOIN filled p ON p.period = CAST({_PREV[freq]} AS DATE)""")


def _make_growth(freq):
    @register(f"growth_{freq}", _growth_sql(freq))
    def q(spark, sf):
        return comparable(temporal.growth(_tx(spark, sf), freq))
    return q


for _f in ("d", "w", "m"):
    _make_growth(_f)

_PATTERN = """SELECT {key}, CAST(sum(quantity) AS BIGINT) AS total_units,
       count(DISTINCT transaction_id) AS transactions FROM fact GROUP BY {key}"""


@register("patterns_by_dow", with_ctes(LINES, select=_PATTERN.format(key="day_of_week")))
def q_patterns_by_dow(spark, sf):
    return temporal.patterns_by_day_of_week(_tx(spark, sf))


@register("patterns_by_month", with_ctes(LINES, "p AS (" + _PATTERN.format(key="month") + ")", select="""
SELECT month, (['Ene','Feb','Mar','Abr','May','Jun','Jul','Ago','Sep','Oct','Nov','Dic'])[month] AS month_name,
       total_units, transactions FROM p"""))
def q_patterns_by_month(spark, sf):
    return temporal.patterns_by_month(_tx(spark, sf))


@register("patterns_by_dayname", with_ctes(LINES, select=_PATTERN.format(key="day_name")))
def q_patterns_by_dayname(spark, sf):
    return temporal.patterns_by_day_name(_tx(spark, sf))


@register("patterns_weekend", with_ctes(LINES, select=_PATTERN.format(key="is_weekend")))
def q_patterns_weekend(spark, sf):
    return temporal.patterns_weekend(_tx(spark, sf))


@register("weekday_counts", with_ctes(LINES, select="""
SELECT day_name, day_of_week, count(*) AS count FROM fact GROUP BY day_name, day_of_week"""))
def q_weekday_counts(spark, sf):
    return temporal.weekday_counts(_fact(spark, sf))


# ---------------------------------------------------------------- top-N

@register("top_products", with_ctes(LINES, PRODUCT_METRICS, select="""
SELECT product_id, product_frequency, unique_customers, total_quantity, round(avg_quantity, 6) AS avg_quantity,
       category_id, category_name,
       CASE WHEN category_name IS NOT NULL THEN 'Producto ' || product_id || ' - ' || category_name
            ELSE 'Producto ' || product_id END AS label
FROM pm ORDER BY total_quantity DESC, product_id LIMIT 10"""))
def q_top_products(spark, sf):
    return comparable(topk.top_products(_pm(spark, sf), 10))


@register("top_customers", with_ctes(LINES, CUSTOMER_METRICS, select="""
SELECT customer_id, frequency, last_purchase_date, total_quantity, unique_products, unique_categories,
       preferred_store, recency, round(avg_basket_size, 6) AS avg_basket_size,
       round(category_diversity_score, 6) AS category_diversity_score
FROM cm ORDER BY frequency DESC, customer_id LIMIT 10"""))
def q_top_customers(spark, sf):
    return comparable(topk.top_customers(_cm(spark, sf), 10))


@register("top_categories", with_ctes(
    LINES, "g AS (" + _GROUP_COUNTS.format(key="category_name", where="WHERE category_name IS NOT NULL") + ")",
    "perf AS (SELECT *, total_units * 100.0 / (SELECT sum(total_units) FROM g) AS percentage FROM g)",
    "top AS (SELECT * FROM perf ORDER BY total_units DESC, category_name LIMIT 10)",
    select="""SELECT category_name, total_units, transactions, customers, products, round(percentage, 6) AS percentage,
       round(total_units * 100.0 / (SELECT sum(total_units) FROM top), 6) AS share FROM top"""))
def q_top_categories(spark, sf):
    return comparable(topk.top_categories(kpis.category_performance(_fact(spark, sf)), 10))


# ---------------------------------------------------------------- statistics

def _corr_sql():
    feats = stats.DEFAULT_CORR_FEATURES
    parts = []
    for i, a in enumerate(feats):
        for b in feats[i:]:
            expr = (f"CASE WHEN stddev_pop({a}) * stddev_pop({b}) > 0 THEN "
                    f"round(covar_pop({a}, {b}) / (stddev_pop({a}) * stddev_pop({b})), 6) END")
            parts.append(f"SELECT '{a}' AS x, '{b}' AS y, {expr} AS corr FROM cm")
            if a != b:
                parts.append(f"SELECT '{b}' AS x, '{a}' AS y, {expr} AS corr FROM cm")
    return "\nUNION ALL\n".join(parts)


@register("correlation_matrix", with_ctes(LINES, CUSTOMER_METRICS, select=_corr_sql()))
def q_correlation_matrix(spark, sf):
    return comparable(stats.correlation_matrix(_cm(spark, sf)))


def _box_sql(src, value, group=None):
    x = f"CAST({value} AS DOUBLE)"
    key = f"{group}, " if group else ""
    gb = f"GROUP BY {group}" if group else ""
    return f"""b AS (SELECT {key}count({x}) AS count, quantile_cont({x}, 0.25) AS q1,
        quantile_cont({x}, 0.5) AS median, quantile_cont({x}, 0.75) AS q3, avg({x}) AS mean,
        stddev_samp({x}) AS std, min({x}) AS min, max({x}) AS max FROM {src} {gb})"""


_BOX_COLS = """count, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
       round(q3 - q1, 6) AS iqr, round(q1 - 1.5 * (q3 - q1), 6) AS lower_fence,
       round(q3 + 1.5 * (q3 - q1), 6) AS upper_fence, round(mean, 6) AS mean, round(std, 6) AS std,
       round(min, 6) AS min, round(max, 6) AS max"""


@register("box_stats", with_ctes(LINES, CUSTOMER_METRICS, _box_sql("cm", "frequency"),
                                 select=f"SELECT {_BOX_COLS} FROM b"))
def q_box_stats(spark, sf):
    return comparable(stats.box_stats(_cm(spark, sf), "frequency"))


@register("box_stats_by_category", with_ctes(LINES, PRODUCT_METRICS,
                                             _box_sql("pm", "total_quantity", "category_name"),
                                             select=f"SELECT category_name, {_BOX_COLS} FROM b"))
def q_box_stats_by_category(spark, sf):
    return comparable(stats.box_stats(_pm(spark, sf), "total_quantity", "category_name"))


@register("outliers", with_ctes(LINES, CUSTOMER_METRICS, _box_sql("cm", "frequency"), select="""
SELECT customer_id, frequency FROM cm, b
WHERE frequency < q1 - 1.5 * (q3 - q1) OR frequency > q3 + 1.5 * (q3 - q1)"""))
def q_outliers(spark, sf):
    return stats.outliers(_cm(spark, sf), "frequency").select("customer_id", "frequency")


def _hist_sql(src, value, bins):
    x = f"CAST({value} AS DOUBLE)"
    return (f"bounds AS (SELECT min({x}) AS lo, max({x}) AS hi FROM {src})", f"""
counts AS (SELECT CAST(CASE WHEN hi - lo > 0 THEN least(floor(({x} - lo) / (hi - lo) * {bins}), {bins - 1})
                       ELSE 0 END AS INTEGER) AS bin, count(*) AS count
           FROM {src}, bounds WHERE {value} IS NOT NULL GROUP BY 1)""", f"""
SELECT CAST(r.range AS INTEGER) AS bin, round(lo + (hi - lo) * r.range / {bins}, 6) AS bin_start,
       round(lo + (hi - lo) * (r.range + 1) / {bins}, 6) AS bin_end, coalesce(c.count, 0) AS count
FROM range({bins}) r CROSS JOIN bounds LEFT JOIN counts c ON c.bin = r.range""")


_H1 = _hist_sql("cm", "total_quantity", 50)
_H2 = _hist_sql("pm", "unique_customers", 30)


@register("histogram", with_ctes(LINES, CUSTOMER_METRICS, _H1[0], _H1[1], select=_H1[2]))
def q_histogram(spark, sf):
    return comparable(stats.histogram(_cm(spark, sf), "total_quantity", 50))


@register("histogram_products", with_ctes(LINES, PRODUCT_METRICS, _H2[0], _H2[1], select=_H2[2]))
def q_histogram_products(spark, sf):
    return comparable(stats.histogram(_pm(spark, sf), "unique_customers", 30))


@register("scatter_xy", with_ctes(LINES, CUSTOMER_METRICS, select="""
SELECT customer_id, frequency AS x, total_quantity AS y FROM cm"""))
def q_scatter_xy(spark, sf):
    return stats.scatter(_cm(spark, sf), "frequency", "total_quantity", key="customer_id")
