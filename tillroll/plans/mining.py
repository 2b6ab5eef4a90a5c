"""Registered checks: collaborative filtering and association rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillroll.operators import cf, rules
from tillroll.plans.oracle_sql import CUSTOMER_METRICS, LINES, with_ctes
from tillroll.plans.registry import ORACLES, comparable, register
from tillroll.plans.warehouse import testdata_warehouse
from tillroll.sources import testdata

TARGET_STEP = 20  # searches are made for every customer whose id is divisible by it


def _fact(spark, sf):
    return testdata_warehouse(spark, sf).fact()


def _targets(spark, sf):
    customers = testdata_warehouse(spark, sf, ["customer_totals"]).state("customer_totals")
    return customers.filter(F.col("customer_id") % TARGET_STEP == 0).select(F.col("customer_id").alias("target_id"))


def _similarity(spark, sf):
    wh = testdata_warehouse(spark, sf, ["customer_totals", "customer_item", "customer_norms"])
    return cf.customer_similarity(wh.customer_item(), _targets(spark, sf), wh.customer_norms(), cf.MIN_SIMILARITY)


_CF = f"""
ci AS (SELECT customer_id, product_id, CAST(sum(quantity) AS BIGINT) AS quantity FROM fact GROUP BY 1, 2),
norms AS (SELECT customer_id, sqrt(sum(quantity * quantity)) AS norm FROM ci GROUP BY 1),
targets AS (SELECT customer_id AS target_id FROM cm WHERE customer_id % {TARGET_STEP} = 0),
tv AS (SELECT t.target_id, ci.product_id, ci.quantity AS tq FROM targets t JOIN ci ON ci.customer_id = t.target_id),
dots AS (SELECT tv.target_id, ci.customer_id, sum(ci.quantity * tv.tq) AS dot
         FROM tv JOIN ci ON ci.product_id = tv.product_id WHERE ci.customer_id <> tv.target_id GROUP BY 1, 2),
sim AS (SELECT d.target_id, d.customer_id, d.dot / (a.norm * b.norm) AS similarity
        FROM dots d JOIN norms a ON a.customer_id = d.customer_id JOIN norms b ON b.customer_id = d.target_id),
nb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY similarity DESC, customer_id)
                      AS rank FROM sim WHERE similarity >= {cf.MIN_SIMILARITY}) WHERE rank <= {cf.TOP_K_SIMILAR})"""


@register("customer_item", with_ctes(LINES, select="""
SELECT customer_id, product_id, CAST(sum(quantity) AS BIGINT) AS quantity FROM fact GROUP BY 1, 2"""))
def q_customer_item(spark, sf):
    return cf.customer_item(_fact(spark, sf))


@register("customer_similarity", with_ctes(LINES, CUSTOMER_METRICS, _CF, select=f"""
SELECT target_id, customer_id, round(similarity, 6) AS similarity FROM sim WHERE similarity >= {cf.MIN_SIMILARITY}"""))
def q_customer_similarity(spark, sf):
    return comparable(_similarity(spark, sf))


@register("similar_customers", with_ctes(LINES, CUSTOMER_METRICS, _CF, select="""
SELECT target_id, customer_id, round(similarity, 6) AS similarity, CAST(rank AS INTEGER) AS rank FROM nb"""))
def q_similar_customers(spark, sf):
    return comparable(cf.similar_customers(_similarity(spark, sf)))


@register("customer_recommendations", with_ctes(LINES, CUSTOMER_METRICS, _CF, f"""
scores AS (SELECT nb.target_id, ci.product_id, sum(nb.similarity * ci.quantity) AS raw_score
           FROM nb JOIN ci ON ci.customer_id = nb.customer_id
           WHERE NOT EXISTS (SELECT 1 FROM ci o WHERE o.customer_id = nb.target_id AND o.product_id = ci.product_id)
           GROUP BY 1, 2)""", f"""
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY raw_score DESC, product_id)
        AS rank FROM scores) WHERE rank <= {cf.TOP_N})""", """
info AS (SELECT product_id, arg_min(category_name, category_id) AS category_name FROM fact GROUP BY 1)""",
    """buyers AS (SELECT product_id, count(*) AS similar_customers_count FROM ci GROUP BY 1)""", select="""
SELECT t.target_id AS customer_id, CAST(t.rank AS INTEGER) AS rank, t.product_id,
       round(round_even(t.raw_score / max(t.raw_score) OVER (PARTITION BY t.target_id) * 100.0, 2), 6) AS score,
       i.category_name, 'Producto ' || t.product_id AS product_name, b.similar_customers_count
FROM top t LEFT JOIN info i ON i.product_id = t.product_id LEFT JOIN buyers b ON b.product_id = t.product_id"""))
def q_customer_recommendations(spark, sf):
    wh = testdata_warehouse(spark, sf, ["customer_totals", "customer_item", "customer_norms", "product_metrics"])
    return comparable(cf.customer_recommendations(
        wh.fact(), _targets(spark, sf), ci=wh.customer_item(), products=wh.product_metrics(),
        norms=wh.customer_norms()))


# ---------------------------------------------------------------- association rules

def _type_lines(spark, sf):
    """(transaction_id, item): the fact's products mapped to their part type."""
    part = testdata.table(spark, sf, "part").select(F.col("p_partkey").alias("product_id"),
                                                     F.col("p_type").alias("item"))
    return _fact(spark, sf).select("transaction_id", "product_id").join(part, "product_id")


def _itemsets(spark, sf):
    return rules.frequent_itemsets(rules.baskets(_type_lines(spark, sf), "item"), rules.MIN_SUPPORT)


def _rules(spark, sf):
    return rules.association_rules(_itemsets(spark, sf), rules.MIN_CONFIDENCE, rules.MIN_LIFT)


_MINED = f"""
ti AS (SELECT DISTINCT f.transaction_id, p.p_type AS item FROM fact f JOIN part p ON p.p_partkey = f.product_id),
idx AS (SELECT item, CAST(row_number() OVER (ORDER BY item) - 1 AS BIGINT) AS bit FROM (SELECT DISTINCT item FROM ti)),
bask AS (SELECT transaction_id, bit_or(CAST(1 AS BIGINT) << bit) AS mask FROM ti JOIN idx USING (item)
         GROUP BY transaction_id),
nb AS (SELECT count(*) AS n FROM bask),
subsets AS (SELECT range AS s FROM range(1, (SELECT CAST(1 AS BIGINT) << count(*) FROM idx))),
freq AS (SELECT s, count(*) AS f FROM subsets, bask WHERE (mask & s) = s GROUP BY s),
fi AS (SELECT s, f, f / (SELECT n FROM nb) AS support FROM freq WHERE f >= {rules.MIN_SUPPORT} * (SELECT n FROM nb)),
names AS (SELECT s, string_agg(item, '|' ORDER BY item) AS items FROM fi JOIN idx ON ((s >> bit) & 1) = 1 GROUP BY s),
allrules AS (
  SELECT a.s AS am, x.s - a.s AS cm, x.support, a.support AS antecedent_support, c.support AS consequent_support,
         x.support / a.support AS confidence, x.support / a.support / c.support AS lift
  FROM fi x JOIN fi a ON (x.s & a.s) = a.s AND a.s <> x.s JOIN fi c ON c.s = x.s - a.s),
rl AS (SELECT * FROM allrules WHERE confidence >= {rules.MIN_CONFIDENCE} AND lift >= {rules.MIN_LIFT})"""

_RULE_COLS = """na.items AS antecedents, nc.items AS consequents,
       round(r.antecedent_support, 6) AS antecedent_support, round(r.consequent_support, 6) AS consequent_support,
       round(r.support, 6) AS support, round(r.confidence, 6) AS confidence, round(r.lift, 6) AS lift,
       round(r.support - r.antecedent_support * r.consequent_support, 6) AS leverage,
       CASE WHEN r.confidence < 1 THEN round((1 - r.consequent_support) / (1 - r.confidence), 6)
            ELSE CAST('Infinity' AS DOUBLE) END AS conviction"""


@register("basket_sample", with_ctes(LINES, """
b AS (SELECT f.transaction_id, array_to_string(list_sort(list(DISTINCT p.p_type)), '|') AS items
      FROM fact f JOIN part p ON p.p_partkey = f.product_id GROUP BY 1)""", select="""
SELECT transaction_id, items FROM b ORDER BY md5(transaction_id || ':42'), transaction_id LIMIT 1000"""))
def q_basket_sample(spark, sf):
    b = rules.baskets(_type_lines(spark, sf), "item")
    return comparable(rules.sample_baskets(b, 1000, seed=42))


@register("frequent_itemsets", with_ctes(LINES, _MINED, select="""
SELECT n.items, f AS freq, round(support, 6) AS support FROM fi JOIN names n USING (s)"""))
def q_frequent_itemsets(spark, sf):
    return comparable(_itemsets(spark, sf))


@register("association_rules", with_ctes(LINES, _MINED, select=f"""
SELECT {_RULE_COLS} FROM rl r JOIN names na ON na.s = r.am JOIN names nc ON nc.s = r.cm"""))
def q_association_rules(spark, sf):
    return comparable(_rules(spark, sf))


_BRAND_SUPPORT, _BRAND_CONFIDENCE = 0.01, 0.1


@register("association_rules_brand", with_ctes(LINES, f"""
ti AS (SELECT DISTINCT transaction_id, category_name AS item FROM fact)""", """
nb AS (SELECT count(DISTINCT transaction_id) AS n FROM ti)""", f"""
f1 AS (SELECT [item] AS items, count(*) AS f FROM ti GROUP BY item HAVING count(*) >= {_BRAND_SUPPORT} * (SELECT n FROM nb))""", f"""
f2 AS (SELECT [a.item, b.item] AS items, count(*) AS f FROM ti a JOIN ti b ON a.transaction_id = b.transaction_id AND a.item < b.item
       GROUP BY a.item, b.item HAVING count(*) >= {_BRAND_SUPPORT} * (SELECT n FROM nb))""", f"""
f3 AS (SELECT [a.item, b.item, c.item] AS items, count(*) AS f FROM ti a JOIN ti b ON a.transaction_id = b.transaction_id AND a.item < b.item
       JOIN ti c ON a.transaction_id = c.transaction_id AND b.item < c.item
       GROUP BY a.item, b.item, c.item HAVING count(*) >= {_BRAND_SUPPORT} * (SELECT n FROM nb))""", f"""
f4 AS (SELECT [a.item, b.item, c.item, d.item] AS items, count(*) AS f FROM ti a JOIN ti b ON a.transaction_id = b.transaction_id AND a.item < b.item
       JOIN ti c ON a.transaction_id = c.transaction_id AND b.item < c.item JOIN ti d ON a.transaction_id = d.transaction_id AND c.item < d.item
       GROUP BY a.item, b.item, c.item, d.item HAVING count(*) >= {_BRAND_SUPPORT} * (SELECT n FROM nb))""", """
fi AS (SELECT items, f / (SELECT n FROM nb) AS support FROM
       (SELECT * FROM f1 UNION ALL SELECT * FROM f2 UNION ALL SELECT * FROM f3 UNION ALL SELECT * FROM f4))""", f"""
r AS (SELECT a.items AS ante, c.items AS cons, a.support AS antecedent_support, c.support AS consequent_support, x.support,
             x.support / a.support AS confidence, x.support / a.support / c.support AS lift
      FROM fi x JOIN fi a ON len(a.items) < len(x.items) AND list_has_all(x.items, a.items)
      JOIN fi c ON len(c.items) = len(x.items) - len(a.items) AND list_has_all(x.items, c.items) AND NOT list_has_any(a.items, c.items)
      WHERE x.support / a.support >= {_BRAND_CONFIDENCE})""", select="""
SELECT array_to_string(ante, '|') AS antecedents, array_to_string(cons, '|') AS consequents,
       round(antecedent_support, 6) AS antecedent_support, round(consequent_support, 6) AS consequent_support,
       round(support, 6) AS support, round(confidence, 6) AS confidence, round(lift, 6) AS lift,
       round(support - antecedent_support * consequent_support, 6) AS leverage,
       CASE WHEN confidence < 1 THEN round((1 - consequent_support) / (1 - confidence), 6) ELSE CAST('Infinity' AS DOUBLE) END AS conviction
FROM r"""))
def q_association_rules_brand(spark, sf):
    """Rules between the 25 brands, by thresholds that baskets of few brands reach."""
    return comparable(rules.build_rules(_fact(spark, sf), "category_name", _BRAND_SUPPORT, _BRAND_CONFIDENCE, None))


@register("rule_stats", with_ctes(LINES, _MINED, select="""
SELECT count(*) AS n_rules, round(avg(lift), 6) AS avg_lift, round(avg(confidence), 6) AS avg_confidence,
       round(avg(support), 6) AS avg_support FROM rl"""))
def q_rule_stats(spark, sf):
    return comparable(rules.rule_stats(_rules(spark, sf)))


@register("top_rules", with_ctes(LINES, _MINED, select=f"""
SELECT {_RULE_COLS} FROM rl r JOIN names na ON na.s = r.am JOIN names nc ON nc.s = r.cm
ORDER BY r.lift DESC, r.confidence DESC, na.items, nc.items LIMIT 5"""))
def q_top_rules(spark, sf):
    return comparable(rules.top_rules(_rules(spark, sf), 5))


_COMPANIONS = """
comp AS (SELECT ia.item AS product_id, ic.item AS companion, r.support, r.confidence, r.lift
         FROM rl r JOIN idx ia ON ((r.am >> ia.bit) & 1) = 1 JOIN idx ic ON ((r.cm >> ic.bit) & 1) = 1
         WHERE ia.item <> ic.item)"""


@register("product_recommendations", with_ctes(LINES, _MINED, _COMPANIONS, f"""
g AS (SELECT product_id, companion, max(support) AS support, max(confidence) AS confidence, max(lift) AS lift
      FROM comp GROUP BY 1, 2)""", f"""
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY lift DESC, companion) AS rank
        FROM g) WHERE rank <= {rules.TOP_N})""", select="""
SELECT product_id, CAST(rank AS INTEGER) AS rank, companion AS recommended_id, round(round_even(support * 100, 2), 6) AS support,
       round(round_even(confidence * 100, 2), 6) AS confidence, round(round_even(lift, 2), 6) AS lift,
       CAST(NULL AS VARCHAR) AS category_name, 'Producto ' || companion AS product_name,
       round(round_even(lift / max(lift) OVER (PARTITION BY product_id) * 100, 2), 6) AS score
FROM top"""))
def q_product_recommendations(spark, sf):
    return comparable(rules.product_recommendations(_rules(spark, sf)))


@register("product_recommendations_decorated", ORACLES["product_recommendations"].replace(
    "CAST(NULL AS VARCHAR) AS category_name, 'Producto ' || companion AS product_name",
    "(SELECT min(p_brand) FROM part WHERE p_type = companion) AS category_name, 'Type ' || companion AS product_name"))
def q_product_recommendations_decorated(spark, sf):
    """The same with a category and a real name for every companion."""
    info = testdata.table(spark, sf, "part").groupBy(F.col("p_type").alias("product_id")).agg(F.min("p_brand").alias("category_name"))
    info = info.withColumn("product_name", F.concat(F.lit("Type "), F.col("product_id")))
    return comparable(rules.product_recommendations(_rules(spark, sf), info=info))


@register("product_recommendations_weighted", with_ctes(LINES, _MINED, _COMPANIONS, f"""
g AS (SELECT product_id, companion, avg(support) AS support, max(confidence) AS confidence, max(lift) AS lift
      FROM comp GROUP BY 1, 2)""", f"""
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY lift DESC, companion) AS rank
        FROM g) WHERE rank <= {rules.TOP_N})""", select="""
SELECT product_id, CAST(rank AS INTEGER) AS rank, companion AS recommended_id, round(support, 6) AS support,
       round(confidence, 6) AS confidence, round(lift, 6) AS lift, 'Sin categoría' AS category_name,
       'Producto ' || companion AS product_name,
       round(lift * 0.5 + confidence * 100 * 0.3 + support * 100 * 0.2, 6) AS score
FROM top"""))
def q_product_recommendations_weighted(spark, sf):
    return comparable(rules.product_recommendations_weighted(_rules(spark, sf)))
