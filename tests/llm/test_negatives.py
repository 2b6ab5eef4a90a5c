"""Hard negatives against all products, and the cover tree's invariants."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillroll.llm import negatives, queries

SCHEMA = "vec_id long, label int, vector array<bigint>, id string, mark int, `odd.name` int, shard int"


def plain(rows, is_anchor, positives=5, count=10):
    """rows: distinct (id, label, vector); scores of all pairs."""
    rows = sorted(set((i, lab, tuple(v)) for i, lab, v in rows if lab is not None and v), key=lambda r: (r[0] is not None, r[0] or 0))
    x = np.array([r[2] for r in rows], dtype=np.int64)
    out = []
    for a, (i, lab, v) in enumerate(rows):
        if i is None or not is_anchor(i):
            continue
        s = (x @ np.array(v, dtype=np.int64)).tolist()
        order = sorted(range(len(rows)), key=lambda k: -s[k])  # rows are in the order of their ids
        for p in [k for k in order if rows[k][1] == lab and k != a][:positives]:
            fit = [k for k in order if rows[k][1] != lab and 30 * s[p] <= 100 * s[k] <= 90 * s[p]][:count]
            out += [(i, rows[p][0], r, rows[k][0], s[p], s[k]) for r, k in enumerate(fit, 1)]
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def clustered(n, d, seed, groups=12, hot=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, d)) * 60
    x = centres[rng.integers(0, groups, n)] + rng.normal(size=(n, d)) * rng.choice([1, 8, 30], size=(n, 1))
    if hot:
        x[rng.permutation(n)[:hot]] = centres[0]
    return np.floor(x).astype(np.int64)


@pytest.mark.parametrize("kind", ["clusters", "noise", "equal", "line"])
def test_cover_tree(kind):
    rng = np.random.default_rng(1)
    x = {"clusters": clustered(900, 6, 2, hot=200), "noise": rng.integers(-50, 50, (500, 30)), "equal": np.ones((300, 4), dtype=np.int64) * 7,
         "line": np.arange(400)[:, None] * np.array([3, 1])}[kind]
    labels = rng.integers(0, 4, len(x))
    longest = int((x * x).sum(1).max())
    t = negatives.CoverTree(x, labels, longest)
    assert sorted(t.order) == list(range(len(x)))
    wide = np.column_stack([x, np.sqrt(np.maximum(longest - (x * x).sum(1), 0))])[t.order]
    assert np.allclose((wide * wide).sum(1), longest)
    for k in range(len(t.centre)):
        a, b = t.start[k], t.end[k]
        assert a <= t.centre[k] < b  # a node's centre is one of its points
        assert np.sqrt(((wide[a:b] - wide[t.centre[k]]) ** 2).sum(1)).max() <= t.radius[k] * (1 + 1e-9) + 1e-9
        assert labels[t.order[a:b]].min() == t.low[k] and labels[t.order[a:b]].max() == t.high[k]
        kids = range(t.first[k], t.last[k])
        if kids:
            assert t.start[kids[0]] == a and t.end[kids[-1]] == b and all(t.end[i] == t.start[i + 1] for i in kids[:-1])
    if kind in ("clusters", "line"):
        assert len(t.centre) > 5


def test_descent_skips_nodes():
    """With clusters apart, most points are never scored, and nothing is lost."""
    x = clustered(3000, 5, 3, groups=60)
    labels = np.arange(3000) % 3
    longest = int((x * x).sum(1).max())
    row = negatives.Shard.row(0, x, np.arange(3000), labels, np.arange(3000), longest)
    s = negatives.Shard(row, longest)
    scored = 0
    for q in range(0, 3000, 100):
        scanned = {}
        centre = s.centre_scores(x[[q]])[0]
        slack = np.sqrt(float(x[q] @ x[q])) * s.radius * (1 + 1e-9) + 1e-6
        out = np.zeros(len(centre), dtype=bool)
        best = s._descend(None, centre + slack, centre - slack, out, scanned, x[q].astype(float), 5, labels[q], True, (q, q))
        scored += sum(len(v) for v in scanned.values())
        scores = x @ x[q]
        want = sorted((k for k in range(3000) if labels[k] == labels[q] and k != q), key=lambda k: (-scores[k], k))[:5]
        assert best[1].tolist() == want
    assert scored < 0.5 * 30 * 3000


@pytest.mark.parametrize(("kind", "size"), [("clusters", 1 << 14), ("noise", 1 << 14), ("small", 1 << 21)])
def test_against_all_pairs(spark, monkeypatch, kind, size):
    """Many shards and blocks, a hot label and a hot vector, tied scores."""
    monkeypatch.setattr(negatives, "SHARD_BYTES", size)
    monkeypatch.setattr(negatives, "BLOCK_BYTES", size // 16)
    rng = np.random.default_rng(4)
    n = 1500
    x = rng.integers(-9, 9, (n, 12)) if kind == "noise" else clustered(n, 8, 5, hot=400)
    labels = np.where(rng.random(n) < 0.4, 1, rng.integers(0, 300 if kind == "small" else 9, n))
    rows = [(k, int(labels[k]), x[k].tolist()) for k in range(n)]
    df = spark.createDataFrame([(*r, "i", 1, 2, 3) for r in rows], SCHEMA).repartition(7)
    out = negatives.mine_negatives(df, F.col("vec_id") % 20 == 0)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = plain(rows, lambda i: i % 20 == 0)
    assert len(want) > 1000 and got(out) == want


def test_nulls_repeats_shared_ids_and_empty_tables(spark):
    rows = [(0, 1, [4, 4]), (0, 1, [4, 4]), (1, 1, [4, 2]), (2, 2, [2, 2]), (3, None, [9, 9]), (4, 2, None), (5, 2, [1, None]), (6, 2, [1]),
            (None, 2, [2, 1]), (None, 1, [4, 3]), (7, 2, []), (0, 3, [1, 2]), (8, 3, [-5, -5]), (8, 3, [5, 5])]
    df = spark.createDataFrame([(*r, "i", 1, 2, 3) for r in rows], SCHEMA)
    out = negatives.mine_negatives(df, F.col("vec_id") % 100 == 0)
    usable = [(0, 1, [4, 4]), (1, 1, [4, 2]), (2, 2, [2, 2]), (None, 2, [2, 1]), (None, 1, [4, 3]), (0, 3, [1, 2]), (8, 3, [-5, -5]), (8, 3, [5, 5])]
    assert got(out) == plain(usable, lambda i: i % 100 == 0) and out.filter("positive_id IS NULL").count() > 0
    assert negatives.mine_negatives(df.limit(0), F.lit(True)).count() == 0
    assert negatives.mine_negatives(df, F.lit(False)).count() == 0
    assert negatives.mine_negatives(df.filter("vec_id = 1"), F.lit(True)).count() == 0


def test_query(spark):
    d = "/root/testdata/sf0.001"
    rows = []
    for r in spark.read.parquet(f"{d}/embeddings.parquet").collect():
        rows.append((r["vec_id"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"], [int(np.floor(float(c) * 256)) for c in r["embedding"]]))
    assert got(queries.op12_hard_negatives(spark, d)) == plain(rows, lambda i: i % 100 == 0)
