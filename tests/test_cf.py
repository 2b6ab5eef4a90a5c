"""Similarities of whole target tables through the prefix index, against all pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tillroll.operators import cf


def vectors(n=120, products=60, seed=1):
    """Customers with a best-seller each (product 0), clusters of near-equal baskets and a null id."""
    rng = random.Random(seed)
    rows = {}
    for c in range(n):
        base = random.Random(c // 6)
        rows[c] = {p: base.randint(1, 9) for p in base.sample(range(1, products), 8)}
        if rng.random() < 0.7:
            rows[c][rng.randrange(1, products)] = rng.randint(1, 30)
        if c % 4:
            rows[c][0] = rng.choice([1, 1, 2, 40])
    rows[200] = {0: 5}
    rows[201] = {59: 1}
    return rows


def all_pairs(rows, targets, bound):
    norm = {c: math.sqrt(sum(q * q for q in v.values())) for c, v in rows.items()}
    out = {}
    for t in targets:
        for c, v in rows.items():
            shared = [p for p in rows[t] if p in v]
            if c != t and shared:
                s = sum(rows[t][p] * v[p] for p in shared) / norm[t] / norm[c]
                if bound is None or s >= bound:
                    out[t, c] = s
    return out


@pytest.fixture(scope="module")
def ci(spark):
    rows = [(c, p, q) for c, v in vectors().items() for p, q in v.items()] + [(None, 0, 3), (None, 5, 2)]
    return spark.createDataFrame(rows, "customer_id long, product_id long, quantity long").repartition(6)


@pytest.mark.parametrize("bound", [None, 0.1, 0.5, 0.95])
@pytest.mark.parametrize("per_key", [100_000, 7])
def test_similarity_of_whole_target_tables(spark, ci, monkeypatch, bound, per_key):
    monkeypatch.setattr(cf, "PER_KEY", per_key)
    targets = [c for c in vectors() if c % 3 == 0] + [200]
    table = spark.createDataFrame([(t,) for t in targets] * 2 + [(999,), (None,)], "target_id long")
    got = {(r["target_id"], r["customer_id"]): r["similarity"] for r in cf.customer_similarity(ci, table, min_similarity=bound).collect()}
    want = all_pairs(vectors(), set(targets), bound)
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)


def test_best_sellers_leave_the_prefix(spark, ci, monkeypatch):
    table = spark.createDataFrame([(t,) for t in range(120)], "target_id long")
    index = cf.prefix_index(ci, table, cf.customer_norms(ci), 0.5)
    # the commonest product stands in a prefix only where it alone reaches the bound
    got = {r["customer_id"]: r["in_prefix"] for r in index.filter("product_id = 0 AND customer_id IS NOT NULL").collect()}
    want = {c: v[0] / math.sqrt(sum(q * q for q in v.values())) >= 0.5 for c, v in vectors().items() if 0 in v}
    assert got == want and sum(want.values()) < len(want) / 2
    # every vector's suffix is shorter than the bound
    assert index.filter("rest >= 0.5").isEmpty()


def test_index_holds_products_of_targets_only(spark, ci):
    rows = vectors()
    some = [c for c in rows if c % 40 == 0]
    index = cf.prefix_index(ci, spark.createDataFrame([(t,) for t in some], "target_id long"), cf.customer_norms(ci), 0.1)
    wanted = {p for t in some for p in rows[t]}
    assert wanted < {p for v in rows.values() for p in v}
    got = {(r["customer_id"], r["product_id"]): r["weight"] for r in index.collect()}
    length = {c: math.sqrt(sum(q * q for q in v.values())) for c, v in rows.items()}  # over all products
    want = {(c, p): q / length[c] for c, v in rows.items() for p, q in v.items() if p in wanted and length[c]}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in want)


def test_recommendations_for_many_targets(spark, ci):
    rows = vectors()
    targets = [c for c in rows if c % 10 == 0]
    table = spark.createDataFrame([(t,) for t in targets], "target_id long")
    products = ci.groupBy("product_id").agg(F.count(F.lit(1)).alias("unique_customers")).withColumn("category_name", F.lit("x"))
    got = cf.customer_recommendations(None, table, top_n=3, ci=ci, products=products).collect()
    sims = all_pairs(rows, targets, cf.MIN_SIMILARITY)
    for t in targets:
        score = {}
        for (a, c), s in sims.items():
            if a == t:
                for p, q in rows[c].items():
                    if p not in rows[t]:
                        score[p] = score.get(p, 0) + s * q
        want = sorted(score, key=lambda p: (-round(score[p], 9), p))[:3]
        assert [r["product_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["customer_id"] == t] == want
