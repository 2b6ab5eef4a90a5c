"""Small hand-computed cases (FIXTURES.md) for individual operators."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tillroll.functions.calendar import calendar_columns, period_label
from tillroll.functions.numeric import pct_change, round_half_even
from tillroll.operators import baskets, catalog, facts, quality, rules, stats
from tillroll.sources import files


def _rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_expand_fixture(spark):
    raw = spark.createDataFrame(
        [(1, dt.date(2013, 1, 1), 102, 1000, "20 3 1 5"),
         (2, dt.date(2013, 1, 1), 103, 1001, "12 12 8"),
         (3, dt.date(2013, 1, 2), 102, 1002, "5 5 5 5")],
        "transaction_id int, date date, store_id int, customer_id long, products string")
    out = baskets.expand_baskets(raw)
    rows = _rows(out, "customer_id", "product_id", "quantity")
    assert len(rows) == 7
    assert (1002, 5, 4) in rows and (1001, 12, 2) in rows
    assert sum(r[2] for r in rows) == 11


def test_expand_edge_tokens(spark):
    raw = spark.createDataFrame(
        [(1, ""), (2, "nan"), (3, None), (4, "a b"), (5, "7 x 7"), (6, " 1   2 "), (7, "+5 -3")],
        "tid int, products string")
    rows = _rows(baskets.expand_baskets(raw), "tid", "product_id", "quantity")
    assert rows == [(5, 7, 2), (6, 1, 1), (6, 2, 1), (7, -3, 1), (7, 5, 1)]


def test_calendar_cases(spark):
    df = spark.createDataFrame([(dt.date(2012, 12, 31),), (dt.date(2013, 1, 6),), (dt.date(2013, 1, 7),)], "date date")
    out = df.select("date", *calendar_columns("date"), period_label(F.col("date"), "W").alias("w")).collect()
    by = {r["date"]: r for r in out}
    assert by[dt.date(2012, 12, 31)]["week_of_year"] == 1
    sun = by[dt.date(2013, 1, 6)]
    assert (sun["day_of_week"], sun["day_name"], sun["is_weekend"]) == (6, "Sunday", 1)
    assert sun["w"] == dt.date(2013, 1, 6)
    assert by[dt.date(2013, 1, 7)]["w"] == dt.date(2013, 1, 13)


def test_preferred_store_ties_to_lowest(spark):
    fact = spark.createDataFrame(
        [(i, dt.date(2013, 1, 1), s, 7, i, 1, 1, "c") for i, s in enumerate([110, 102, 110, 102, 103])],
        "transaction_id long, date date, store_id int, customer_id long, product_id long, quantity long, "
        "category_id int, category_name string")
    assert facts.customer_metrics(fact).first()["preferred_store"] == 102


def test_quartiles_and_half_even(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,)], "v double")
    b = stats.box_stats(df, "v").first()
    assert (b["q1"], b["q3"]) == (1.75, 3.25)
    assert spark.range(1).select(round_half_even(F.lit(0.125), 2)).first()[0] == 0.12


def test_pct_change_cases(spark):
    df = spark.createDataFrame([(5, 0), (0, 0), (5, None), (15, 10)], "cur long, prev long")
    got = [r[0] for r in df.select(pct_change("cur", "prev")).collect()]
    assert got[0] == math.inf and got[1] is None and got[2] is None and got[3] == pytest.approx(50.0)


def test_correlation_constant_column_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0)], "a double, b double")
    out = {(r["x"], r["y"]): r["corr"] for r in stats.correlation_matrix(df, ["a", "b"]).collect()}
    assert out[("a", "b")] is None and out[("b", "b")] is None
    assert out[("a", "a")] == pytest.approx(1.0)


def test_repeated_item_counted_once(spark):
    lines = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (2, "b")], "transaction_id int, item string")
    b = rules.baskets(lines, "item")
    assert sorted((r[0], tuple(r[1])) for r in b.collect()) == [(1, ("a",)), (2, ("a", "b"))]
    items = rules.frequent_itemsets(b, 0.5)
    assert {(tuple(r["items"]), r["freq"]) for r in items.collect()} == {(("a",), 2), (("b",), 1), (("a", "b"), 1)}


def test_rules_multi_item_consequents_brute_force(spark):
    baskets_ = [["a", "b", "c"], ["a", "b", "c"], ["a", "b"], ["a", "c"], ["b", "c"], ["a"]]
    lines = spark.createDataFrame([(i, x) for i, bk in enumerate(baskets_) for x in bk], "transaction_id int, item string")
    its = rules.frequent_itemsets(rules.baskets(lines, "item"), 0.3)
    got = {(tuple(r["antecedents"]), tuple(r["consequents"])): r["confidence"]
           for r in rules.association_rules(its, 0.0, None).collect()}
    # brute force over all splits of frequent itemsets
    from itertools import combinations
    n = len(baskets_)

    def sup(s):
        return sum(set(s) <= set(b) for b in baskets_) / n
    expect = {}
    for size in (2, 3):
        for s in combinations("abc", size):
            if sup(s) < 0.3:
                continue
            for k in range(1, size):
                for a in combinations(s, k):
                    c = tuple(x for x in s if x not in a)
                    expect[(a, c)] = sup(s) / sup(a)
    assert got.keys() == expect.keys()
    assert any(len(c) == 2 for _, c in got)
    for k, v in expect.items():
        assert got[k] == pytest.approx(v)


def test_dedupe_keep_last(spark):
    df = spark.createDataFrame([(2000, 100, 0), (2001, 101, 1), (2002, 102, 2), (2001, 103, 3), (2000, 104, 4)],
                               "product_id long, category_id int, pos long")
    assert _rows(catalog.dedupe_keep_last(df, "product_id"), "product_id", "category_id") == \
        [(2000, 104), (2001, 103), (2002, 102)]


def test_upsert_add_and_replace(spark):
    old = spark.createDataFrame([(i, f"old{i}", i) for i in range(1, 11)], "category_id int, category_name string, pos long")
    new5 = spark.createDataFrame([(100 + i, f"n{i}", i) for i in range(5)], "category_id int, category_name string, pos long")
    added = catalog.upsert(old, new5, "category_id", "add")
    assert added.count() == 15
    assert catalog.kept_keys(old, added, "category_id").count() == 10
    new8 = spark.createDataFrame([(200 + i, f"r{i}", i) for i in range(8)], "category_id int, category_name string, pos long")
    assert catalog.upsert(old, new8, "category_id", "replace").count() == 8
    rep = catalog.upsert_report(old, new5, added).first()
    assert (rep["added"], rep["updated"]) == (5, 0)


def test_validate_categories_duplicates(spark):
    df = spark.createDataFrame([(100, "A"), (101, "B"), (101, "C"), (-1, "D")], "category_id int, category_name string")
    got = {r["check"]: (r["ok"], r["n_bad"]) for r in quality.validate_categories(df).collect()}
    assert got["duplicate_ids"] == (False, 1) and got["nonpositive_category_id"] == (False, 1)
    assert got["all_valid"][0] is False


@pytest.mark.parametrize("sep,header", [("|", False), ("|", True), (",", False), (",", True)])
def test_transaction_file_formats(spark, tmp_path, sep, header):
    rows = ["2013-01-01|102|1000|20 3 1 5", "2013-01-01|103|1001|12 12 8", "2013-01-02|102|1002|5 5 5 5"]
    text = "\n".join(r.replace("|", sep) for r in rows) + "\n"
    if header:
        text = sep.join(["date", "store_id", "customer_id", "products"]) + "\n" + text
    p = tmp_path / "t.csv"
    p.write_text(text)
    got, fmt = files.read_delimited(spark, str(p), ["date", "store_id", "customer_id", "products"])
    f = fmt.first()
    assert (f["delimiter"], f["has_header"], f["ok"]) == (sep, header, True)
    assert _rows(got, "date", "store_id", "customer_id", "products") == \
        sorted(tuple(r.split("|")) for r in rows)


def test_categories_trim_and_vcode_header(spark, tmp_path):
    c = tmp_path / "c.csv"
    c.write_text("100|  Categoria Test 1 \n101|Categoria Test 2\n102|Categoria Test 3\n")
    cats = files.load_categories(spark, str(c))
    assert _rows(cats, "category_id", "category_name")[0] == (100, "Categoria Test 1")
    pc = tmp_path / "pc.csv"
    pc.write_text("v.Code|Categoria\n1000|100\n1001|101\n1002|102\n")
    assert _rows(files.load_product_category(spark, str(pc)), "product_id", "category_id") == \
        [(1000, 100), (1001, 101), (1002, 102)]


def test_store_gate_rejects_mislabelled_file(spark, tmp_path):
    (tmp_path / "102_Tran.csv").write_text("2013-01-01|102|1000|1 2\n2013-01-02|102|1001|3\n")
    (tmp_path / "103_Tran.csv").write_text("2013-01-01|103|1000|1\n2013-01-01|102|1001|2\n")
    rows, report = files.load_transactions(spark, str(tmp_path))
    acc = {r["file_store"]: r["accepted"] for r in report.collect()}
    assert acc == {"102": True, "103": False}
    assert rows.count() == 2


def test_same_answer_for_1_and_8_partitions(spark):
    from tillroll.sources import testdata
    f = testdata.fact(spark, "/root/testdata/sf0.001")
    a = facts.customer_metrics(f.coalesce(1)).collect()
    b = facts.customer_metrics(f.repartition(8)).collect()
    key = lambda r: r["customer_id"]
    assert sorted(a, key=key) == sorted(b, key=key)


def test_sample_exact_and_stable(spark):
    df = spark.range(1000).select(F.col("id").alias("transaction_id"), F.array(F.lit("x")).alias("items"))
    s1 = {r[0] for r in rules.sample_baskets(df.repartition(3), 100).collect()}
    s2 = {r[0] for r in rules.sample_baskets(df.repartition(7), 100).collect()}
    assert len(s1) == 100 and s1 == s2


def test_sample_equals_global_hash_order(spark):
    df = spark.range(5000).select(F.col("id").alias("transaction_id"), F.array(F.lit("x")).alias("items"))
    h = F.md5(F.concat_ws(":", F.col("transaction_id").cast("string"), F.lit("42")))
    want = [r[0] for r in df.orderBy(h, "transaction_id").limit(300).collect()]
    got = [r[0] for r in rules.sample_baskets(df.repartition(5), 300, seed=42).collect()]
    assert sorted(got) == sorted(want)


def test_approximate_distinct_counts_close(spark):
    from tillroll.operators import kpis
    from tillroll.sources import testdata
    f = testdata.fact(spark, "/root/testdata/sf0.001").cache()
    exact = kpis.kpis(f).first()
    approx = kpis.kpis(f, exact=False).first()
    for c in ("total_customers", "total_products"):
        assert abs(approx[c] - exact[c]) <= 0.05 * exact[c]


def test_enrich_fanout_and_dedupe(spark):
    fact = spark.createDataFrame([(1, 7, 2)], "transaction_id int, product_id long, quantity long")
    pc = spark.createDataFrame([(7, 100, 0), (7, 101, 1)], "product_id long, category_id int, pos long")
    cats = spark.createDataFrame([(100, "A"), (101, "B")], "category_id int, category_name string")
    assert baskets.enrich(fact, pc, cats).count() == 2
    assert _rows(baskets.enrich(fact, pc, cats, dedupe=True), "category_name") == [("B",)]


def test_recommendation_uses_product_name_when_present(spark):
    from tillroll.operators import cf
    fact = spark.createDataFrame([(1, 7, "Leche", 1, "A"), (2, 8, None, 1, "A")],
                                 "transaction_id int, product_id long, product_name string, category_id int, "
                                 "category_name string")
    got = {r["product_id"]: r["product_name"] for r in cf.product_info(fact).collect()}
    assert got == {7: "Leche", 8: "Producto 8"}


def test_rebuild_from_files_with_integrity(spark, tmp_path):
    from tillroll.plans.rebuild import rebuild
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "102_Tran.csv").write_text("2013-01-01|102|1000|20 3 1 5\n2013-01-02|102|1002|5 5 5 5\n")
    (raw / "103_Tran.csv").write_text("date,store_id,customer_id,products\n2013-01-01,103,1001,12 12 8\n")
    (tmp_path / "cats.csv").write_text("100|A\n101|B\n")
    (tmp_path / "pc.csv").write_text("v.Code|Categoria\n20|100\n3|100\n1|101\n5|101\n12|100\n8|999\n")
    wh, report, integ = rebuild(spark, str(raw), str(tmp_path / "cats.csv"), str(tmp_path / "pc.csv"),
                                str(tmp_path / "out"), with_integrity=True)
    f = wh.fact()
    assert f.count() == 7 and f.agg(F.sum("quantity")).first()[0] == 11
    assert f.filter(F.col("category_id").isNull()).count() == 0
    assert f.filter(F.col("category_name").isNull()).count() == 1  # product 8 -> undefined category 999
    i = integ.first()
    assert i["undefined_categories"] == 1 and i["valid"] is True
    assert {r["file_store"] for r in report.collect() if r["accepted"]} == {"102", "103"}
    assert wh.customer_metrics().count() == 3


def test_quoted_cells_round_trip(spark, tmp_path):
    (tmp_path / "102_Tran.csv").write_text('2013-01-01,102,1000,"20 3 1 5"\n2013-01-02,102,1001,"7"\n')
    rows, _ = files.load_transactions(spark, str(tmp_path))
    assert sorted(r["products"] for r in rows.collect()) == ["20 3 1 5", "7"]
    names = [(1, "Frutas, verduras"), (2, 'say "hi", you'), (3, "plain")]
    files.write_delimited(spark.createDataFrame(names, "category_id int, category_name string").coalesce(1), str(tmp_path / "cats.csv"), sep=",", header=True)
    got = files.load_categories(spark, str(tmp_path / "cats.csv"))
    assert _rows(got, "category_id", "category_name") == names


def test_every_file_is_reported_and_bad_rows_are_kept_apart(spark, tmp_path):
    from tillroll.plans.rebuild import rebuild
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "102_Tran.csv").write_text("2013-01-01|102|1000|1 2\nnever|102|1001|3\n2013-01-01|102|x|4\n")
    (raw / "103_Tran.csv").write_text("date,store_id,customer_id\n2013-01-01,103,1\n")
    (raw / "test_999_Tran.csv").write_text("2013-01-01|999|1000|1\n")
    (tmp_path / "c.csv").write_text("1|a\n")
    (tmp_path / "p.csv").write_text("1|1\n2|1\n")
    from tillroll.plans.rebuild import InvalidLoad
    with pytest.raises(InvalidLoad) as e:
        rebuild(spark, str(raw), str(tmp_path / "c.csv"), str(tmp_path / "p.csv"), str(tmp_path / "no"))
    assert e.value.figures == {"rows": 3, "null_date": 1, "null_customer_id": 1, "null_products": 0}
    assert not (tmp_path / "no" / "manifest").exists()
    wh, report = rebuild(spark, str(raw), str(tmp_path / "c.csv"), str(tmp_path / "p.csv"), str(tmp_path / "out"), on_invalid="reject")
    got = {r["source"].rsplit("/", 1)[1]: (r["accepted"], r["bad_dates"], r["bad_customer_ids"], r["missing_columns"]) for r in report.collect()}
    assert got == {"102_Tran.csv": (True, 1, 1, []), "103_Tran.csv": (False, 0, 0, ["products"]), "test_999_Tran.csv": (False, 0, 0, [])}
    assert sorted(r["reason"] for r in spark.read.parquet(str(tmp_path / "out" / "rejected")).collect()) == ["bad customer id", "bad date"]
    assert wh.fact().count() == 2
    (raw / "102_Tran.csv").unlink()
    with pytest.raises(ValueError, match="no store file"):
        rebuild(spark, str(raw), str(tmp_path / "c.csv"), str(tmp_path / "p.csv"), str(tmp_path / "out2"))


def test_text_is_scanned_once(spark, tmp_path, monkeypatch):
    """Every raw file is in one text scan of all plans that a rebuild runs."""
    import re
    from pyspark.sql import DataFrameWriter
    from pyspark.sql.classic.dataframe import DataFrame
    from tillroll.plans.rebuild import rebuild
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "102_Tran.csv").write_text("2013-01-01|102|1000|1 2\n2013-01-01|102|1|4\n")
    (raw / "103_Tran.csv").write_text("date,store_id,customer_id,products\n2013-01-01,103,1,7\n")
    (tmp_path / "c.csv").write_text("1|a\n")
    (tmp_path / "p.csv").write_text("1|1\n2|1\n")
    plans = []
    noted = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    write = DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **k: (noted(self._df), write(self, *a, **k))[1])
    for name in ("collect", "count", "isEmpty", "toLocalIterator"):
        run = getattr(DataFrame, name)
        monkeypatch.setattr(DataFrame, name, lambda self, *a, f=run, **k: (noted(self), f(self, *a, **k))[1])
    wh, report = rebuild(spark, str(raw), str(tmp_path / "c.csv"), str(tmp_path / "p.csv"), str(tmp_path / "out"))
    assert report.count() == 2 and wh.fact().count() == 4
    scans = [m for p in plans for m in re.findall(r"FileScan text .*?Location: [^\[]*\[(.*?)\]", p)]
    assert len(plans) > 10 and len(scans) == 3, scans  # baskets, categories, relation
    named = [n for s in scans for n in re.findall(r"[^/, ]+\.csv", s)]
    assert len(named) == len(set(named)) and {"c.csv", "p.csv"} <= set(named)


def test_catalogue_faults_reach_the_caller(spark, tmp_path):
    (tmp_path / "c.csv").write_text("1|A\nx|B\n|C\n2|D\n")
    with pytest.raises(ValueError, match=r"c\.csv: ids that are not numbers \(2 rows\)"):
        files.load_categories(spark, str(tmp_path / "c.csv"))
    rows, rejected, report = files.read_catalogue(spark, str(tmp_path / "c.csv"), "categories")
    assert _rows(rows, "category_id", "category_name") == [(1, "A"), (2, "D")]
    assert _rows(rejected, "row_no", "category_id", "category_name") == [(1, "x", "B"), (2, "", "C")]
    r = report.first()
    assert (r["rows"], r["bad_rows"], r["accepted"]) == (4, 2, False)
    (tmp_path / "s.csv").write_text("category_id,label\n1,A\n")
    with pytest.raises(ValueError, match=r"columns missing or surplus \(category_name\)"):
        files.load_categories(spark, str(tmp_path / "s.csv"))
    (tmp_path / "p.csv").write_text("v.Code|Categoria\n1|2\nx|3\n4|\n")
    rows, rejected, report = files.read_catalogue(spark, str(tmp_path / "p.csv"), "product_category")
    assert _rows(rows, "product_id", "category_id") == [(1, 2)] and rejected.count() == 2 and report.first()["accepted"]


def test_every_catalogue_file_is_reported_with_all_its_rows(spark, tmp_path):
    from tillroll.plans.maintenance import q_catalogue_report
    sizes = [2, 9, 3, 50, 7]
    spark.createDataFrame([(i, f"Brand#{11 + i % 4}", n) for i, n in enumerate(sizes, 1)], "p_partkey long, p_brand string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    got = {r["file"]: (r["rows"], r["bad_rows"], r["accepted"]) for r in q_catalogue_report(spark, str(tmp_path)).collect()}
    assert got == {"categories.csv": (4, 0, True), "categories_bad.csv": (4, 1, False), "categories_short.csv": (4, 0, False),
                   "product_category.csv": (5, 0, True), "product_category_bad.csv": (5, 2, True)}
    (tmp_path / "p.csv").write_text("v.Code|Categoria|Otra\n1|2|3\n \n4|5|6\n")
    rows, rejected, report = files.read_catalogue(spark, str(tmp_path / "p.csv"), "product_category")
    assert rows.count() == rejected.count() == 0 and report.first()["rows"] == 2 and not report.first()["accepted"]


def test_quality_of_coincident_centroids(spark):
    df = spark.createDataFrame([(0, [0.0, 0.0]), (0, [2.0, 2.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0])], "cluster int, x array<double>")
    from tillroll.operators import segments
    q = segments.cluster_quality(df, 2).first()
    assert q["davies_bouldin"] == float("inf") and q["k"] == 2
    assert segments.cluster_quality(df.filter("cluster = 0"), 2).first()["calinski_harabasz"] is None


def test_transaction_ids_do_not_depend_on_read_splits(spark, tmp_path):
    from tillroll.plans.rebuild import raw_batch
    lines = [f"2013-01-{i % 28 + 1:02d}|102|{i % 50}|{i} {i + 1}" + ("\n" if i % 9 == 0 else "") for i in range(2000)]
    (tmp_path / "102_Tran.csv").write_text("\n".join(lines) + "\n")
    setting, got = "spark.sql.files.maxPartitionBytes", []
    before = spark.conf.get(setting)
    for size in ("128MB", "6KB"):
        spark.conf.set(setting, size)
        rows, _ = files.load_transactions(spark, str(tmp_path))
        got.append(_rows(raw_batch(rows), "transaction_id", "customer_id", "products"))
    spark.conf.set(setting, before)
    assert got[0] == got[1] and len({r[0] for r in got[0]}) == 2000


def test_appended_version_equals_a_full_rebuild(spark, tmp_path):
    from tillroll.plans.rebuild import append_batch
    from tillroll.plans.warehouse import Warehouse, write_processed
    schema = "transaction_id string, date date, store_id int, customer_id long, products string"
    old = [("a", dt.date(2013, 1, 1), 102, 1, "1 1 2"), ("b", dt.date(2013, 1, 2), 103, 2, "2 3"), ("n", dt.date(2013, 1, 2), 103, None, "9")]
    new = [("c", dt.date(2013, 2, 1), 103, 1, "3 9"), ("d", dt.date(2013, 2, 1), 103, 4, "1")]
    pc = spark.createDataFrame([(1, 10), (2, 10), (3, 11), (3, 12)], "product_id long, category_id int")
    cats = spark.createDataFrame([(10, "A"), (11, "B")], "category_id int, category_name string")
    fact = lambda rows: catalog.batch_fact(spark.createDataFrame(rows, schema), pc, cats)
    first = write_processed(spark, fact(old), str(tmp_path / "v1"))
    second = append_batch(spark, first, spark.createDataFrame(new, schema), pc, cats, str(tmp_path / "v2"), batch_id="feb")
    assert append_batch(spark, second, spark.createDataFrame(new, schema), pc, cats, str(tmp_path / "v3"), batch_id="feb") is second
    whole = write_processed(spark, fact(old + new), str(tmp_path / "all"))
    reread = Warehouse.open(spark, str(tmp_path / "v2"))
    for name in ("fact", "transaction_metrics", "customer_metrics", "product_metrics", "customer_item", "customer_norms"):
        want, got = getattr(whole, name)(), getattr(reread, name)()
        assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect())), name
    f = whole.fact()
    for name, direct in (("customer_metrics", facts.customer_metrics(f)), ("product_metrics", facts.product_metrics(f))):
        assert sorted(map(str, getattr(whole, name)().collect())) == sorted(map(str, direct.collect())), name


def _batches(spark):
    schema = "transaction_id string, date date, store_id int, customer_id long, products string"
    old = [(f"o{i}", dt.date(2013, 1, 1 + i % 28), 102 + i % 2, i % 40, f"{i % 7} {i % 11} 3") for i in range(200)]
    pc = spark.createDataFrame([(i, i % 4) for i in range(11)], "product_id long, category_id int")
    cats = spark.createDataFrame([(i, f"C{i}") for i in range(3)], "category_id int, category_name string")
    return schema, old, pc, cats


def test_append_rewrites_touched_buckets_only(spark, tmp_path):
    from tillroll.plans.rebuild import append_batch
    from tillroll.plans.warehouse import write_processed
    schema, old, pc, cats = _batches(spark)
    raw = lambda rows: spark.createDataFrame(rows, schema)
    first = write_processed(spark, catalog.batch_fact(raw(old), pc, cats), str(tmp_path / "v1"))
    files = lambda root: {p: p.stat().st_mtime_ns for p in (tmp_path / root).rglob("*") if p.is_file()}
    before = files("v1")
    new = [("n1", dt.date(2013, 2, 1), 102, 5, "1 1 2"), ("n2", dt.date(2013, 2, 1), 102, 5, "3")]
    second = append_batch(spark, first, raw(new), pc, cats, str(tmp_path / "v2"))
    assert files("v1") == before  # the older version stays as it was
    for name in ("customer_item", "customer_visits", "customer_totals"):
        moved = {b for b, root in second.states[name].items() if root == second.root}
        assert moved == second.buckets_of(raw(new), "customer_id") and len(moved) == 1 < len(second.states[name])
        assert {int(p.name[7:]) for p in (tmp_path / "v2" / name).glob("bucket=*")} == moved
    whole = write_processed(spark, catalog.batch_fact(raw(old + new), pc, cats), str(tmp_path / "all"), buckets=3)
    for name in second.states:
        assert sorted(map(str, second.state(name).collect())) == sorted(map(str, whole.state(name).collect())), name
    assert second.rows == whole.rows


def test_batch_with_stored_or_repeated_ids(spark, tmp_path):
    from tillroll.plans.rebuild import append_batch
    from tillroll.plans.warehouse import KnownTransactions, write_processed
    schema, old, pc, cats = _batches(spark)
    raw = lambda rows: spark.createDataFrame(rows, schema)
    first = write_processed(spark, catalog.batch_fact(raw(old), pc, cats), str(tmp_path / "v1"))
    new = [("n1", dt.date(2013, 2, 1), 102, 5, "1 1 2")]
    with pytest.raises(KnownTransactions) as e:
        append_batch(spark, first, raw(old[:30] + new), pc, cats, str(tmp_path / "v2"))
    assert e.value.n == 30 and not (tmp_path / "v2" / "manifest").exists()
    with pytest.raises(KnownTransactions, match="several baskets"):
        append_batch(spark, first, raw(new + new), pc, cats, str(tmp_path / "v3"))
    second = append_batch(spark, first, raw(old[:30] + new), pc, cats, str(tmp_path / "v4"), on_known="skip")
    whole = write_processed(spark, catalog.batch_fact(raw(old + new), pc, cats), str(tmp_path / "all"))
    assert second.rows == whole.rows
    assert sorted(map(str, second.customer_metrics().collect())) == sorted(map(str, whole.customer_metrics().select(*second.customer_metrics().columns).collect()))


def test_known_baskets_are_found_before_any_is_expanded(spark, tmp_path, monkeypatch):
    from tillroll.plans import rebuild
    from tillroll.plans.warehouse import KnownTransactions, write_processed
    schema, old, pc, cats = _batches(spark)
    raw = lambda rows: spark.createDataFrame(rows, schema)
    first = write_processed(spark, catalog.batch_fact(raw(old), pc, cats), str(tmp_path / "v1"))
    expanded, expand = [], catalog.batch_fact
    monkeypatch.setattr(catalog, "batch_fact", lambda r, *more: expanded.append(r.count()) or expand(r, *more))
    new = [("n1", dt.date(2013, 2, 1), 102, 5, "1 1 2"), (None, dt.date(2013, 2, 1), 102, 6, "3")]
    empty = [(*old[40][:4], "x")]  # a stored id, but no product
    with pytest.raises(KnownTransactions) as e:
        rebuild.append_batch(spark, first, raw(old[:30] + empty + new), pc, cats, str(tmp_path / "v2"))
    assert e.value.n == 30 and not expanded and not (tmp_path / "v2").exists()
    second = rebuild.append_batch(spark, first, raw(old[:30] + empty + new), pc, cats, str(tmp_path / "v3"), on_known="skip")
    assert expanded == [2] and second.transaction_metrics().count() == 202
    third = rebuild.append_batch(spark, first, raw(empty + new), pc, cats, str(tmp_path / "v4"))
    assert third.rows == second.rows


def test_known_keys_and_the_filters_bound(spark, monkeypatch):
    from tillroll.operators import known
    stored = spark.range(5000).select(F.concat(F.lit("t"), "id").alias("k"))
    batch = spark.range(4990, 5400).select(F.concat(F.lit("t"), "id").alias("k")).unionByName(spark.createDataFrame([(None,), ("t1",), ("t1",)], "k string"))
    want = sorted([f"t{i}" for i in range(4990, 5000)] + ["t1"])
    assert sorted(r["k"] for r in known.known_keys(batch, stored, "k").collect()) == want
    pages, bits = known.bloom_filter(batch, "k", 411)
    through = stored.withColumn("p", pages.scalar()).filter(known.may_hold(F.col("p"), bits, F.col("k"))).count()
    assert 11 <= through < 100  # most stored ids are not joined
    monkeypatch.setattr(known, "MOST_BYTES", 10)
    assert known.bloom_filter(batch, "k", 411) is None
    assert sorted(r["k"] for r in known.known_keys(batch, stored, "k").collect()) == want
    assert known.known_keys(batch.limit(0), stored, "k").count() == 0


def test_bitmaps_count_distinct_ids(spark):
    from tillroll.operators import members
    rows = [(d, s, c, p, k) for d in range(3) for s in (1, None) for c in (0, 1, -5, 40_000, None, 2**40) for p in (7, 8) for k in (1, None)]
    f = spark.createDataFrame(rows, "date int, store_id int, customer_id long, product_id long, category_id int")
    m = members.pages(f, ["date", "store_id"]).unionByName(members.pages(f.filter("date = 1"), ["date", "store_id"]))
    got = {r["store_id"]: r["n"] for r in members.count_members(m, ["store_id"], "customer", "n").collect()}
    assert got == {1: 5, None: 5}
    assert spark.range(1).select(members.count_all(m, "product"), members.count_all(m, "category")).first()[:] == (2, 1)
    assert spark.range(1).select(members.count_all(m.limit(0), "product")).first()[0] == 0


def test_change_report_classes(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "d"), (None, "n")], "k int, v string")
    new = spark.createDataFrame([(1, "a"), (2, "B"), (3, None), (5, None), (None, "m")], "k int, v string")
    got = {r["k"]: (r["change"], r["old_v"], r["new_v"]) for r in catalog.change_report(old, new, "k").collect()}
    assert got == {1: ("unchanged", "a", "a"), 2: ("changed", "b", "B"), 3: ("unchanged", None, None), 4: ("removed", "d", None),
                   5: ("added", None, None), None: ("changed", "n", "m")}
    counts = catalog.change_counts(catalog.change_report(old, new, "k")).first()
    assert counts.asDict() == {"added": 1, "changed": 2, "removed": 1, "unchanged": 2}


def test_lookups_open_their_buckets_only(spark, tmp_path):
    import re
    from tillroll.operators import kpis
    from tillroll.plans.warehouse import write_processed
    schema, old, pc, cats = _batches(spark)
    wh = write_processed(spark, catalog.batch_fact(spark.createDataFrame(old, schema), pc, cats), str(tmp_path / "v1"))
    ids = spark.createDataFrame([(5,), (999,)], "customer_id long")
    out = wh.customer_statistics(ids)
    opened = set(re.findall(r"/(\w+/bucket=\d+)/", " ".join(out.inputFiles())))
    assert opened and {o.split("=")[1] for o in opened} <= {str(b) for b in wh.buckets_of(ids, "customer_id")}
    every = kpis.customer_statistics(wh.fact())
    assert out.collect() == every.filter("customer_id = 5").collect()
    assert sorted(map(str, wh.customer_statistics().collect())) == sorted(map(str, every.collect()))
    # no Expand and no fact in the stored figures
    for df in (wh.customer_statistics(), kpis.category_performance_stored(wh.state("category_totals"), wh.state("category_members")),
               kpis.store_performance_stored(wh.transaction_metrics(), wh.state("day_members")),
               catalog.data_status_stored(wh.state("category_totals"), wh.state("day_members"))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Expand" not in plan and "transactions_expanded" not in plan


def test_stream_takes_layouts_rejections_and_redelivered_files(spark, tmp_path):
    from tillroll.streaming.ingest import AGAIN, ingest_stream
    raw, fact, report = tmp_path / "raw", tmp_path / "fact", tmp_path / "report"
    raw.mkdir()
    (raw / "102_Tran.csv").write_text("2013-01-01|102|1000|1 2\nnever|102|1001|3\n2013-01-01|102|x|4\n")
    (raw / "103_Tran.csv").write_text('date,store_id,customer_id,products\n2013-01-01,103,1,"7 7"\n')
    (raw / "104_Tran.csv").write_text("2013-01-01|102|1000|1 2\n")
    pc = spark.createDataFrame([(1, 1), (2, 1), (7, 1)], "product_id long, category_id int")
    cats = spark.createDataFrame([(1, "a")], "category_id int, category_name string")
    go = lambda: ingest_stream(spark, str(raw), pc, cats, str(fact), str(tmp_path / "ck"), 1, str(report)).awaitTermination()
    go()
    (raw / "0103_Tran.csv").write_text((raw / "103_Tran.csv").read_text())  # delivered again under another name
    (raw / "105_Tran.csv").write_text("2013-01-05|105|9|2\n")
    go()
    read = lambda root: spark.read.option("basePath", str(root)).parquet(f"{root}/batch_id=*")
    assert _rows(read(fact), "store_id", "customer_id", "product_id", "quantity") == [(102, 1000, 1, 1), (102, 1000, 2, 1), (103, 1, 7, 2), (105, 9, 2, 1)]
    assert read(fact).select("transaction_id").distinct().count() == 3
    assert sorted(r["reason"] for r in read(report / "rejected").collect()) == ["bad customer id", "bad date"]
    gate = sorted((r["file_store"], r["accepted"], r["reason"]) for r in read(report / "gate").collect())
    assert gate == [("0103", False, AGAIN), ("102", True, None), ("103", True, None), ("104", False, "rows of another store"), ("105", True, None)]


def test_quantiles_match_percentile(spark):
    from tillroll.operators.quantiles import quantiles
    df = spark.range(500).select(F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id") % 3).alias("g"),
                                 F.when(F.col("id") % 11 > 0, (F.col("id") * 37 % 101) / 7).alias("v"))
    probs = [0.0, 0.1, 0.5, 0.75, 1.0]
    want = {r[0]: r[1] for r in df.groupBy("g").agg(F.percentile("v", probs)).collect()}
    got = {r[0]: r[1] for r in quantiles(df, "v", probs, "g").collect()}
    assert set(got) == set(want)
    for k in want:
        assert got[k] == pytest.approx(want[k])
    assert quantiles(df.filter("false"), "v", probs).count() == 0
    assert stats.box_stats(df.filter("false"), "v").first()["median"] is None


def test_rules_grow_only_confident_consequents(spark):
    rows = [(1, ["a", "b", "c"])] * 6 + [(2, ["a", "b"])] * 2 + [(3, ["d"])] * 2
    b = spark.createDataFrame(rows, "transaction_id int, items array<string>")
    got = {(tuple(r["antecedents"]), tuple(r["consequents"])): r["confidence"]
           for r in rules.association_rules(rules.frequent_itemsets(b, 0.1), 0.7, None).collect()}
    every = {(("a",), ("b",)): 1.0, (("b",), ("a",)): 1.0, (("a",), ("c",)): 0.75, (("b",), ("c",)): 0.75, (("c",), ("a",)): 1.0,
             (("c",), ("b",)): 1.0, (("a", "b"), ("c",)): 0.75, (("a", "c"), ("b",)): 1.0, (("b", "c"), ("a",)): 1.0,
             (("a",), ("b", "c")): 0.75, (("b",), ("a", "c")): 0.75, (("c",), ("a", "b")): 1.0}
    assert set(got) == set(every)
    for k, v in every.items():
        assert got[k] == pytest.approx(v)
    assert rules.association_rules(rules.frequent_itemsets(b.limit(0), 0.1), 0.7, None).count() == 0
