"""Training-data operators: brute-force versions and edge cases (nulls, empty
and long texts, ties, repeated rows, empty tables, clashing column names)."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillroll.llm import chat, decontam, exact, licenses, lines, mixing, ngram_join, quality, substring, toxicity

SCHEMA = "doc_id long, text string, source string, score int, n_words string, kept string, `odd.name` int"
WORDS = [f"w{k}" for k in range(40)]


def texts():
    rng = random.Random(3)
    prose = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    shared, base, line = prose(30), prose(120), "This line of boilerplate is in many documents, word for word."
    near = base.split()
    near[60] = "changed"
    out = [(k, f"{prose(25)}\n{line}\n{shared} {prose(15)}") for k in range(8)]
    out += [(20, base), (21, " ".join(near)), (22, base), (23, base.replace(" ", "\n")), (24, prose(9000)), (25, "é" * 50 + " " + shared)]
    out += [(30, None), (31, ""), (32, " \n\t"), (None, "one two three"), (33, "one two"), (33, "one two"), (34, shared + " " + shared), (35, "x" * 30_000)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i in (3, 30) else f"s{(i or 0) % 3}", 1, "n", "k", 7) for i, t in texts()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, *cols):
    out = defaultdict(list)
    for r in df.select("doc_id", *cols).collect():
        out[r[0]].append(tuple(r)[1:])
    return out


def split(text):
    return (text or "").encode().split()


# ---------------------------------------------------------------- 1
def brute_links(rows, threshold=0.8):
    sets = []
    for i, t in rows:
        w = split(t)
        sets.append((i, frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else None))
    n = len(sets)
    links = [[b for b in range(n) if a != b and sets[a][1] and sets[b][1] and len(sets[a][1] & sets[b][1]) >= threshold * len(sets[a][1] | sets[b][1])] for a in range(n)]
    low = [-1 if i is None else i for i, _ in sets]
    root = list(range(n))
    for _ in range(n):
        root = [min([root[a], *(root[b] for b in links[a])], key=lambda x: (low[x], x)) for a in range(n)]
    return [(sets[a][0], sets[root[a]][0], len(links[a])) for a in range(n)]


@pytest.mark.parametrize("block", [512, 2])
def test_ngram_join(docs, block, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_TEXTS", block)
    got = sorted(map(tuple, ngram_join.ngram_join(docs).select("doc_id", "class_id", "n_links").collect()), key=str)
    assert got == sorted(brute_links(texts()), key=str)


def test_prefix_is_shortened_to_the_recall():
    k = ngram_join.prefix_length(0.999)
    assert ngram_join.recall(k) >= 0.999 > ngram_join.recall(k + 1)
    with pytest.raises(ValueError):
        ngram_join.prefix_length(0.999, 0.25)


@pytest.mark.parametrize("threshold, target", [(0.8, 0.999), (0.6, 0.5)])
def test_links_do_not_depend_on_the_size_of_groups(spark, monkeypatch, threshold, target):
    """Near copies in one group or in blocks: the same links, also where a low target loses some."""
    rng = random.Random(8)
    base = [rng.choice(WORDS) for _ in range(200)]
    rows = []
    for k in range(60):
        words = list(base)
        for at in rng.sample(range(200), rng.choice([1, 2, 6])):
            words[at] = f"x{k}y{at}"
        rows.append((k, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = []
    for block in (512, 8):
        monkeypatch.setattr(ngram_join, "BLOCK_TEXTS", block)
        out.append(sorted(map(tuple, ngram_join.ngram_join(df, threshold=threshold, target=target).collect())))
    every = sum(n for *_, n in brute_links(rows, threshold))
    assert out[0] == out[1] and target * every <= sum(r[2] for r in out[0]) <= every > 0


def test_recall_against_all_pairs(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    want = {i: n for i, _, n in brute_links(rows)}
    got = {r["doc_id"]: r["n_links"] for r in ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] <= n for i, n in want.items()) and sum(got.values()) >= 0.999 * sum(want.values()) > 0


# ---------------------------------------------------------------- 2
def brute_substring(rows, window=20):
    order = sorted({(-1 if i is None else i, t) for i, t in rows}, key=lambda x: x[0])
    seen, out = set(), {}
    for i, t in order:
        w, hit = split(t), set()
        for k in range(len(w) - window + 1):
            x = tuple(w[k : k + window])
            if x in seen:
                hit.update(range(k, k + window))
            seen.add(x)
        out[i] = (len(w), len(hit), b" ".join(x for k, x in enumerate(w) if k not in hit).decode())
    return out


def test_substring_dedup(docs):
    got = by_id(substring.dedup_substrings(docs), "n_words", "n_removed", "kept_text")
    want = brute_substring(texts())
    assert {(-1 if k is None else k): set(v) for k, v in got.items()} == {k: {v} for k, v in want.items()}
    assert sum(map(len, got.values())) == len(texts())


@pytest.mark.parametrize("window, gram", [(50, 8), (8, 8)])
def test_substring_dedup_of_other_windows(docs, window, gram):
    got = by_id(substring.dedup_substrings(docs, window=window, gram=gram), "n_words", "n_removed", "kept_text")
    want = brute_substring(texts(), window)
    assert {(-1 if k is None else k): set(v) for k, v in got.items()} == {k: {v} for k, v in want.items()}
    with pytest.raises(ValueError):
        substring.dedup_substrings(docs, window=gram - 1, gram=gram)


# ---------------------------------------------------------------- 5
def test_exact_dedup(docs):
    got = exact.exact_dedup(docs, support=0.1).collect()
    groups = defaultdict(list)
    for i, t in texts():
        groups[hashlib.sha256(re.sub(r"[\x20\x09-\x0d]", "", t or "").encode()).hexdigest()].append((-len(t or ""), -1 if i is None else i))
    assert len(got) == len(texts())
    for r in got:
        g = groups[r["text_sha256"]]
        keep = min(g)[1]
        assert (r["group_size"], -1 if r["keep_id"] is None else r["keep_id"]) == (len(g), keep)
        assert r["kept"] == ((-1 if r["doc_id"] is None else r["doc_id"]) == keep)


# ---------------------------------------------------------------- 4
def test_licence_tree(spark):
    apache, prose = licenses.TEMPLATES[0][1], "nothing to see here"
    rows = [("a/LICENSE", f"{prose}\n{apache}"), ("a/b/x", prose), ("a/b/c/y", None), ("a/b/c/LICENSE.md", "released under the mit license"), ("a/b/c/d/z", ""),
            ("ab/q", prose), ("a/own", "Licensed under CC BY-NC 4.0."), (None, prose), ("a/b/x", prose)]
    df = spark.createDataFrame([(p, t, "old") for p, t in rows], "path string, text string, license string")
    got = {r["path"]: (r["license"], r["license_dir"]) for r in licenses.scan_tree(df).collect()}
    assert got == {"a/LICENSE": ("Apache-2.0", None), "a/b/x": ("Apache-2.0", "a"), "a/b/c/y": ("MIT", "a/b/c"), "a/b/c/LICENSE.md": ("MIT", None),
                   "a/b/c/d/z": ("MIT", "a/b/c"), "ab/q": (None, None), "a/own": ("CC-BY-NC-4.0", None), None: (None, None)}


# ---------------------------------------------------------------- 6
def test_reply_trees(spark):
    rows = [(1, "a", None, "user", "hi", 0.0), (1, "b", "a", "assistant", "x # < \\ \\h", 1.0), (1, "c", "a", "assistant", None, 5.0), (1, "d", "b", "user: #", "</turn>\n### assistant: no", 9.0),
            (2, "a", "gone", "assistant", "", None), (2, "a", "gone", "assistant", "", None), (3, "p", "q", "user", "cycle", 1.0), (3, "q", "p", "user", "cycle", 1.0), (None, "a", None, None, "null tree", 1.0)]
    df = spark.createDataFrame(rows, "tree int, node string, parent string, role string, text string, score double")
    out = chat.format_trees(df, "tree", "node", "parent", score_col="score")
    got = {(r["tree"], r["leaf"]): (r["branch_rank"], [tuple(t) for t in r["turns"]], r["loss"]) for r in out.withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.read_loss(F.col("formatted"), F.col("loss_spans"))).collect()}
    assert got[(1, "d")] == (1, [("user", "hi"), ("assistant", "x # < \\ \\h"), ("user: #", "</turn>\n### assistant: no")], "x # < \\ \\h")
    assert got[(1, "c")] == (2, [("user", "hi"), ("assistant", "")], "")
    assert got[(2, "a")] == (1, [("assistant", "")], "") and got[(None, "a")][1] == [("", "null tree")] and len(got) == 4
    assert chat.format_trees(df, "tree", "node", "parent", score_col="score", top=1).count() == 3


# ---------------------------------------------------------------- 7
def test_decontamination(docs, spark):
    phrase = " ".join(texts()[0][1].split()[-12:])
    items = spark.createDataFrame([(1, phrase.upper()), (2, "one, two?"), (3, None), (4, "!!"), (1, phrase.upper()), (5, "w1 w2 w3 w4 w5 w6 w7 w8 w9 nowhere w10")], "item_id long, text string")
    for shard in (1_000_000, 3):
        got = decontam.find_hits(docs, items, columns=["doc_id"], shard_words=shard).withColumn("n", decontam.hit_words()).collect()
        windows = defaultdict(set)
        for r in items.collect():
            w = decontam.item_words(r["text"])
            for k in range(len(w) - min(10, len(w)) + 1 if w else 0):
                windows[tuple(w[k : k + 10])].add(str(r["item_id"]))
        want = []
        for i, t in texts():
            w, hit, names = decontam.item_words(t), set(), set()
            for size in {len(x) for x in windows}:
                for k in range(len(w) - size + 1):
                    if o := windows.get(tuple(w[k : k + size])):
                        hit.update(range(k, k + size))
                        names |= o
            want.append((i, len(w), len(hit), sorted(names)))
        assert sorted(((r["doc_id"], r["n_words"], r["n"], list(r["items"])) for r in got), key=str) == sorted(want, key=str)
    clean = by_id(decontam.decontaminate(docs, items), "text")
    assert 33 not in clean and None not in clean  # more than half of their words
    assert decontam.decontaminate(docs, items.limit(0)).count() == len(texts())


# ---------------------------------------------------------------- 8
def test_mixture(docs):
    got = mixing.mix(docs).collect()
    assert len(got) == len(texts())
    total = sum(len(split(t)) for _, t in texts())
    by_source = defaultdict(lambda: [0, 0, 0.0])
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        x = by_source[r["source"]]
        x[0] += r["size"]
        x[1] += r["taken"]
        x[2] = r["target"]
    for size, taken, target in by_source.values():
        assert abs(taken - target) <= 1 and target <= 3 * size + 1e-9
    assert abs(sum(x[2] for x in by_source.values()) - total) < 1e-6 * total
    copies = mixing.mixture(docs).select(F.sum(F.size(F.split(F.trim("text"), r"\s+")))).first()[0]
    assert copies == sum(r["taken"] for r in got)


# ---------------------------------------------------------------- 10
@pytest.mark.parametrize("bits", [1 << 20, 1 << 9])
def test_line_dedup(docs, bits):
    key = lambda x: x.strip("\t\n\x0b\x0c\r ").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    low = lambda i: -1 if i is None else i
    holders = defaultdict(set)
    for i, t in texts():
        for x in (t or "").split("\n"):
            holders[key(x)].add(low(i))
    want = []
    for i, t in texts():
        every = (t or "").split("\n")
        kept = [x for x in every if len(key(x)) < 40 or len(holders[key(x)]) < 5 or low(i) == max(holders[key(x)])]
        want.append((i, len(every), len(every) - len(kept), "\n".join(kept)))
    got = lines.line_dedup(docs, filter_bits=bits).select("doc_id", "n_lines", "n_dropped", "kept_text").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert sum(x[2] for x in want) > 0


def test_line_filters_in_slices(spark):
    assert lines.filter_sizes(0, 1 << 26, 1 << 29) == (1 << 26, 1)
    assert lines.filter_sizes(9_000_000, 1 << 26, 1 << 29) == (1 << 27, 1)
    assert lines.filter_sizes(140_000_000, 1 << 26, 1 << 29) == (1 << 29, 3)
    assert lines.filter_sizes(10**13, 1 << 26, 1 << 29) == (1 << 29, lines.MOST_SLICES)
    # 600 hashes, every third of them in two rows at least; negative ones too
    rows = [(k, bytearray(), (h * 7919 - 2_000_000) * 2**40 + h, (h * 10472 - 3_000_000) * 2**38 + 3 * h) for h in range(600) for k in range(1 if h % 3 else 2 + h % 5)]
    keys = spark.createDataFrame(rows, lines.KEYS).repartition(3)
    want = {(h1, h2) for k, _, h1, h2 in rows if k}
    for bits in (1 << 9, 1 << 20):
        assert lines.filter_sizes(len(rows), bits, bits)[1] == (1 if bits > 1 << 9 else -(-8 * len(rows) // bits))
        found = Counter((r["h1"], r["h2"]) for r in lines.suspects(keys, bits, bits).collect())
        every = Counter((h1, h2) for _, _, h1, h2 in rows)
        assert want <= set(found) and all(every[x] == n for x, n in found.items())
    assert len(found) < 300  # a filter with room turns most single hashes away


@pytest.mark.parametrize("bits", [1 << 9, 1 << 10])
def test_line_dedup_in_slices(spark, bits):
    docs = spark.createDataFrame([(k, "\n".join([f"{'the same long line of boilerplate number':<44} {j}" for j in range(k % 4, 12)] + [f"a line that is found in document {k} alone, {j}" for j in range(9)]))
                                  for k in range(24)], "doc_id long, text string")
    want = {tuple(r) for r in lines.line_dedup(docs).select("doc_id", "n_dropped", "kept_text").collect()}
    assert {tuple(r) for r in lines.line_dedup(docs, filter_bits=bits, most_bits=bits).select("doc_id", "n_dropped", "kept_text").collect()} == want
    assert sum(r[1] for r in want) == sum(12 - k % 4 for k in range(24)) - 12


# ---------------------------------------------------------------- 3, 9
@pytest.mark.parametrize("score, column, modulus, rest, positive", [
    (quality.score_quality, "quality", 5, 0, 0), (toxicity.score_toxicity, "toxic", 4, 2, 1)])
def test_classifiers_on_held_out_rows(spark, score, column, modulus, rest, positive):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == rest
    rows = score(spark.read.parquet(f"{sf}/documents.parquet"), labels.filter(~fold)).join(labels.filter(fold), "doc_id").collect()
    assert all(0 <= r["score"] <= 1 for r in rows) and len(rows) > 30
    good, bad = ([r["score"] for r in rows if r[column] == x] for x in (1, 0))
    assert sum((a > b) + 0.5 * (a == b) for a in good for b in bad) / (len(good) * len(bad)) > 0.75
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % modulus == rest for r in rows)


@pytest.mark.parametrize("score, column", [(quality.score_quality, "quality"), (toxicity.score_toxicity, "toxic")])
def test_classifiers_edge_cases(spark, docs, empty, score, column):
    labels = spark.createDataFrame([(k, k % 2) for k in range(8)] + [(20, None), (None, 1), (7, 0)], f"doc_id long, {column} int")
    got = score(docs, labels).collect()
    assert len(got) == len(texts()) and all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in score(docs, labels.limit(0)).collect()} == {0.5}
    assert score(empty, labels).count() == 0


# ---------------------------------------------------------------- all
def test_empty_tables(spark, empty):
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    for out in (ngram_join.ngram_join(empty), substring.dedup_substrings(empty), exact.exact_dedup(empty), exact.keep_first(empty), lines.line_dedup(empty),
                mixing.mix(empty), decontam.decontaminate(empty, items), licenses.scan_tree(empty, "source"),
                chat.format_trees(chat.chain(empty, "doc_id", ["score"]), "doc_id", "node", "parent", "kept", score_col=None)):
        assert out.count() == 0


def test_clashing_columns_are_replaced_once(docs):
    for out in (substring.dedup_substrings(docs), lines.line_dedup(docs.withColumnRenamed("kept", "N_LINES")), mixing.mix(docs.withColumnRenamed("kept", "Size"))):
        names = [c.lower() for c in out.columns]
        assert len(names) == len(set(names)) and "odd.name" in names
    assert exact.keep_first(docs).columns.count("doc_id") == 1


CLASHES = ["_id", "_doc", "_key", "_text", "_size", "_range", "_digest", "_source", "places", "_drop", "drop", "_lines", "_best", "_dir", "_keep", "_of", "__id", "id", "key", "stats", "rest",
           "epochs", "cut_range", "p_source", "low", "node", "digest", "_places", "_stats", "_part", "_place", "_whole", "hit_spans", "c0", "before"]


def test_columns_named_like_internal_ones_stay(docs, spark):
    """Extra columns come out as they went in, whatever their names."""
    wide = docs.select("doc_id", "text", "source", *[F.concat(F.lit(c + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(c) for c in CLASHES])
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(8)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    every = ["doc_id", *CLASHES]
    want = sorted(map(tuple, wide.select(every).collect()), key=str)
    for out in (ngram_join.ngram_join(wide, columns=every), substring.dedup_substrings(wide), lines.line_dedup(wide), mixing.mix(wide), quality.score_quality(wide, labels, keep=every),
                toxicity.score_toxicity(wide, labels, keep=every)):
        assert sorted(map(tuple, out.select(every).collect()), key=str) == want
    found = decontam.find_hits(wide, items).select([c for c in every if c != "hit_spans"])  # a result column
    assert found.count() == len(want)
    kept = exact.keep_first(wide).select(every).collect()
    assert {tuple(r) for r in kept} <= set(want)
    assert {r["doc_id"] for r in kept} == {r["keep_id"] for r in exact.exact_dedup(docs).collect()}


def test_keep_first_knows_rows_by_their_text(spark):
    rows = [(1, "a"), (1, "b"), (0, "b"), (2, "a a"), (2, "a a")]
    kept = exact.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "text", "group_size").collect()
    assert sorted(map(tuple, kept)) == [(0, "b", 2), (1, "a", 1), (2, "a a", 2), (2, "a a", 2)]


def test_mix_of_rows_without_ids_is_the_same_on_every_run(spark):
    """The budget ends among texts of one size without an id: which is cut must not depend on the partitions."""
    texts = [f"a{k} b c d" for k in range(60)]
    def run(order, parts):
        df = spark.createDataFrame([(None, t, "s") for t in order] + [(5, f"x{k} y", "t") for k in range(10)], "doc_id long, text string, source string").repartition(parts)
        return sorted((r["text"], r["taken"]) for r in mixing.mix(df).collect())
    one = run(texts, 1)
    assert one == run(texts[::-1], 7) and len({t for _, t in one}) > 1


def test_sums_of_ftrl_by_slot(spark):
    """fit() against one FTRL-proximal run over the same rows in the same order."""
    rng = random.Random(4)
    rows = sorted(((float(k % 3 == 0), " ".join(rng.choice(WORDS[: 20 if k % 3 else 40]) for _ in range(12))) for k in range(60)), key=lambda r: r[1])
    model = toxicity.fit(spark.createDataFrame(rows, "label double, text string").repartition(1).sortWithinPartitions("text"))
    n, positive = len(rows), sum(y for y, _ in rows)
    plain = toxicity.Ftrl.new(positive / n, min(3.0, toxicity.L1_PER_ROOT_ROW * n**0.5))
    for _ in range(toxicity.ROUNDS):
        plain.z, plain.n = plain.z.astype("f4").astype(float), plain.n.astype("f4").astype(float)
        for y, text in rows:
            raw = np.frombuffer(text.encode(), np.uint8)
            _, slots, words = toxicity.features(raw, np.array([0]), np.array([len(raw)]))
            plain.learn(slots, int(words[0]), y)
    w = plain.weights(np.arange(len(plain.z)))
    got = np.zeros(len(w) - 1)
    got[model.slots] = model.weights
    # weights begin at 0 where |z| passes L1, so a slot at that edge may be in one of them only
    assert len(model.slots) and np.allclose(got, w[:-1], atol=1e-4) and abs(model.constant - w[-1]) < 1e-4


def test_ridge_and_isotonic_fit(spark):
    """fit() against normal equations of all rows at once, isotonic() against its min-max formula."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, len(quality.STATS))).astype("f4").astype(float)
    y = (x[:, 0] + 0.3 * rng.normal(size=300) > 0).astype(float)
    rows = [(k, int(y[k]), x[k].tolist()) for k in range(300)]
    model = quality.fit(spark.createDataFrame(rows, "id long, label int, stats array<float>").repartition(5))
    z = quality.Features(x.mean(axis=0), x.std(axis=0))(x)
    beta = np.linalg.solve(z.T @ z + quality.RIDGE * 300 * np.eye(z.shape[1]), z.T @ y)
    assert np.allclose(z @ model.beta, z @ beta, atol=1e-6)
    n, good = rng.integers(1, 9, 40).astype(float), np.zeros(40)
    good = np.minimum(n, rng.integers(0, 9, 40)).astype(float)
    mean = lambda a, b: good[a : b + 1].sum() / n[a : b + 1].sum()
    want = [max(min(mean(a, b) for b in range(i, 40)) for a in range(i + 1)) for i in range(40)]
    centres, means = quality.isotonic(np.arange(40.0), n, good)
    groups = [[i for i in range(40) if want[i] == v] for v in sorted(set(want))]
    rate = good.sum() / n.sum()
    assert len(groups) == len(means) and np.allclose(means, [(good[g].sum() + 0.5 * rate) / (n[g].sum() + 0.5) for g in groups])
    assert np.allclose(centres, [(np.arange(40.0)[g] * n[g]).sum() / n[g].sum() for g in groups])
