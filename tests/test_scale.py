"""What bounds the work of large loads: evaluations, part files, sizes of tasks."""

import datetime as dt

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tillroll import session
from tillroll.operators import baskets, catalog, facts
from tillroll.plans import warehouse
from tillroll.sources import files, testdata
from tillroll.streaming import ingest


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_baskets_are_cut_once_whatever_separates_tokens(spark):
    rows = [(1, "3 1 3"), (2, "3\t1\n3"), (3, " 2  x 2 "), (4, ""), (5, None), (6, "nan a"), (7, "5 x 5 5"), (8, "\x0b4\f4\r")]
    raw = spark.createDataFrame(rows, "tid int, products string")
    out = baskets.expand_baskets(raw)
    got = sorted((r["tid"], r["product_id"], r["quantity"]) for r in out.collect())
    assert got == [(1, 1, 1), (1, 3, 2), (2, 1, 1), (2, 3, 2), (3, 2, 2), (7, 5, 3), (8, 4, 2)]
    assert _plan(baskets.expand_baskets(spark.range(3).select("id", F.col("id").cast("string").alias("products")))).count("sort_array(") == 1


def test_append_summary_expands_the_upload_once(spark):
    schema = "transaction_id string, date date, store_id int, customer_id long, products string"
    raw = spark.createDataFrame([("a", dt.date(2013, 1, 1), 1, 1, "1 1 2"), ("b", dt.date(2013, 1, 1), 1, None, "3"), ("c", dt.date(2013, 1, 1), 1, 4, "2")], schema)
    pc, cats = spark.createDataFrame([(1, 1)], "product_id long, category_id int"), spark.createDataFrame([(1, "A")], "category_id int, category_name string")
    old = spark.createDataFrame([(1, 2)], "customer_id long, product_id long")
    out = catalog.append_summary_stored(old.select("customer_id"), old.select("product_id"), catalog.batch_fact(raw, pc, cats))
    assert "Generate" not in _plan(out)
    assert out.first().asDict() == {"rows": 4, "customers": 2, "products": 3, "new_customers": 1, "new_products": 2}


def test_part_files_do_not_follow_the_shuffles(spark):
    setting, before = "spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set(setting, "64")
    b = spark.range(4000).repartition(64, "id").select((F.col("id") % 3).cast("int").alias("store_id"), F.repeat(F.lit("17 "), 20).alias("products"))
    stored = testdata._by_store(b, "test-baskets")
    spark.conf.set(setting, before)
    assert len(stored.inputFiles()) == 3 and stored.count() == 4000 and stored.columns == ["store_id", "products"]
    assert {r["store_id"] for r in stored.select("store_id").distinct().collect()} == {0, 1, 2}


def test_catalogues_are_written_without_the_baskets(spark, tmp_path):
    spark.createDataFrame([(1, "Brand#11", 5), (2, "Brand#12", 9)], "p_partkey long, p_brand string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    raw, mixed = testdata.raw_catalogues(spark, str(tmp_path)), testdata.mixed_catalogues(spark, str(tmp_path))  # there are no orders
    assert {"categories", "categories_header", "product_category"} <= set(raw) and {"categories", "product_category", "faulty"} <= set(mixed)
    assert spark.read.text(raw["product_category"]).count() > 2


def test_tasks_are_only_made_smaller(spark):
    sizes = {k: spark.conf.get(k) for k in session._TASKS}
    for given, files, shuffle in (("1g", 32 << 20, 16 << 20), ("128MB", 32 << 20, 16 << 20), ("134217728b", 32 << 20, 16 << 20), ("6KB", "6KB", "6KB"), ("4m", "4m", "4m")):
        for k in sizes:
            spark.conf.set(k, given)
        session.small_tasks(spark)
        assert [spark.conf.get(k) for k in sizes] == [str(files), str(shuffle)], given
    for k, v in sizes.items():
        spark.conf.set(k, v)


def test_lines_of_one_compressed_file_are_cut_by_all_tasks(spark, tmp_path):
    lines = spark.range(0, 3000, 1, 1).select(F.concat(F.lit("2013-1-5|1|7|"), F.col("id").cast("string"), F.repeat(F.lit(" 12345"), 60)))
    lines.write.option("compression", "gzip").text(str(tmp_path / "1_Tran.csv"))
    landed = session.written(ingest.spread(files.numbered(files.with_source(spark.read.text(str(tmp_path / "1_Tran.csv"))))), "test-landing")
    rows, report = files.gated(landed)
    assert len(rows.inputFiles()) >= spark.sparkContext.defaultParallelism  # one, when a task had them all
    assert sorted(r["row_no"] for r in rows.select("row_no").collect()) == list(range(3000)) and report.first()["accepted"]


def test_a_stream_does_not_gather_its_catalogue_at_the_driver(spark, tmp_path, monkeypatch):
    """20,000 rows in files of some 40 KB, which take 0.9 MB when broadcast: over a bound of 256 KB."""
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "1_Tran.csv").write_text("".join(f"2013-01-05|1|{i}|{i} 9 {i + 20000}\n" for i in range(300)))
    pc = session.written(spark.range(20000).select(F.col("id").alias("product_id"), (F.col("id") % 25).cast("int").alias("category_id")), "test-products")
    cats = spark.range(25).select(F.col("id").cast("int").alias("category_id"), F.concat(F.lit("C"), "id").alias("category_name"))
    plans, build = [], ingest.build_fact
    def seen(*tables):
        plans.append(_plan(build(*tables)))
        return build(*tables)
    monkeypatch.setattr(ingest, "build_fact", seen)
    setting, before = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set(setting, "256k")
    ingest.ingest_stream(spark, str(tmp_path / "raw"), pc, cats, str(tmp_path / "fact"), str(tmp_path / "ck")).awaitTermination()
    spark.conf.set(setting, before)
    assert plans[0].count("SortMergeJoin [product_id") == 1 and plans[0].count("BroadcastHashJoin [category_id") == 1
    got = spark.read.parquet(str(tmp_path / "fact" / "batch_id=*")).select("product_id", "category_name").distinct()
    assert got.filter("category_name IS NULL").count() == 300 and got.filter("category_name = concat('C', product_id % 25)").count() == 300


def test_fact_rows_are_written_by_month(spark):
    fact = baskets.build_fact(spark.range(0, 2000, 1, 8).select(
        F.col("id").alias("transaction_id"), F.expr("date_add(DATE'2013-01-01', cast(id % 365 AS INT))").alias("date"), F.lit(1).alias("store_id"),
        F.col("id").alias("customer_id"), F.lit(1).cast("bigint").alias("product_id"), F.lit(1).cast("bigint").alias("quantity")),
        spark.createDataFrame([(1, 1)], "product_id long, category_id int"), spark.createDataFrame([(1, "A")], "category_id int, category_name string"))
    rows = warehouse.by_month(fact)
    above, below = _plan(rows).split("REBALANCE", 1)
    assert "date_format" in above and "date_format" not in below
    assert rows.schema == fact.select(*rows.columns).schema and sorted(rows.collect()) == sorted(fact.select(*rows.columns).collect())


def test_ordered_store_file_follows_the_data(spark, tmp_path):
    """Store 1 of the mixed files comes in order, in part files by size, whatever the shuffles."""
    spark.range(0, 40000, 1, 8).select(F.col("id").alias("o_orderkey"), F.lit("1995-01-05").cast("date").alias("o_orderdate"),
                                       F.concat((F.col("id") % 4 + 1).cast("string"), F.lit("-X")).alias("o_orderpriority"), (F.col("id") % 50).alias("o_custkey")).write.parquet(str(tmp_path / "orders.parquet"))
    spark.range(0, 160000, 1, 8).select(F.expr("id div 4").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), F.xxhash64("id").alias("l_partkey"),
                                        F.lit(9.0).alias("l_quantity")).write.parquet(str(tmp_path / "lineitem.parquet"))
    root = testdata._write_mixed_files(spark, str(tmp_path), str(tmp_path / "out"))["root"]
    text = spark.read.text(f"{root}/1_Tran.csv")
    assert len(text.inputFiles()) == len(spark.read.text(f"{root}/4_Tran.csv").inputFiles()) == 1
    dates = [r["value"].split('","')[0] for r in text.collect()[1:]]
    assert len(dates) == 10000 and [d == '"never' for d in dates] == [t % 7 == 3 for t in range(0, 40000, 4)]


def _tables(spark, root):
    """Orders of two days, two lines each, of seven customers and five parts."""
    spark.range(0, 40, 1, 2).select(F.col("id").alias("o_orderkey"), F.expr("date_add(DATE'1995-01-30', cast(id % 4 AS INT))").alias("o_orderdate"),
                                    F.lit("1-X").alias("o_orderpriority"), (F.col("id") % 7).alias("o_custkey")).write.parquet(f"{root}/orders.parquet")
    spark.range(0, 80, 1, 2).select(F.expr("id div 2").alias("l_orderkey"), (F.col("id") % 5).alias("l_partkey"), F.lit(2.0).alias("l_quantity")).write.parquet(f"{root}/lineitem.parquet")
    spark.range(5).select(F.col("id").alias("p_partkey"), F.concat(F.lit("Brand#1"), F.col("id").cast("string")).alias("p_brand")).write.parquet(f"{root}/part.parquet")


def _written(spark, path):
    try:
        return len(spark.read.parquet(path).inputFiles()) > 0
    except AnalysisException:
        return False


def test_tables_are_built_when_a_query_reads_them(spark, tmp_path):
    _tables(spark, tmp_path)
    there = lambda wh: {t for t in warehouse.TABLES if _written(spark, wh.path(t))}
    wh = warehouse.testdata_warehouse(spark, str(tmp_path), ["customer_metrics"])
    assert there(wh) == {"transactions_expanded", "customer_metrics", "customer_totals", "customer_item", "customer_visits"}
    got = sorted(map(str, wh.customer_metrics().collect()))
    assert got == sorted(map(str, facts.customer_metrics(wh.fact()).collect())) and len(got) == 7
    before = wh.fact().inputFiles() + wh.customer_metrics().inputFiles()
    whole = warehouse.testdata_warehouse(spark, str(tmp_path))
    assert whole is wh and there(wh) == set(warehouse.TABLES) and before == wh.fact().inputFiles() + wh.customer_metrics().inputFiles()
    assert warehouse.Warehouse.open(spark, wh.root).rows["customer_metrics"] == 7
    assert sorted(map(str, wh.product_metrics().collect())) == sorted(map(str, facts.product_metrics(wh.fact()).collect()))


def _bought(spark):
    """Fact rows of 40 customers; none has 300 rows, 7 has 315, the others 15."""
    customer = "CASE WHEN id < 300 THEN 7 WHEN id < 600 THEN NULL ELSE id % 40 END"
    lines = spark.range(0, 1200, 1, 4).select(
        F.expr("id div 3").alias("transaction_id"), F.expr("date_add(DATE'2013-01-01', cast(id div 3 % 50 AS INT))").alias("date"), F.expr("cast(id div 3 % 4 AS INT)").alias("store_id"),
        F.expr(customer).alias("customer_id"), (F.col("id") % 30).alias("product_id"), (F.col("id") % 5).alias("quantity"))
    pc = spark.range(30).select(F.col("id").alias("product_id"), F.expr("cast(id % 9 AS INT)").alias("category_id"))
    return baskets.build_fact(lines, pc, spark.createDataFrame([(i, f"C{i}") for i in range(8)], "category_id int, category_name string"))


def test_a_customers_state_rows_lie_in_one_file(spark, tmp_path):
    """Rows are dealt by customer for all states of customers: none is shuffled again, and
    the metrics' shuffles get one row a customer, not one a state row."""
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "false")
    wh = warehouse.write_processed(spark, _bought(spark), str(tmp_path / "wh"))
    spark.conf.set(setting, before)
    for name in ("customer_item", "customer_visits", "customer_totals"):
        files_of = wh.state(name).select("customer_id", F.input_file_name().alias("file")).groupBy("customer_id").agg(F.countDistinct("file").alias("files"))
        assert {r["files"] for r in files_of.collect()} == {1}, name
    made, _ = warehouse._customer_states(wh.fact(), ["customer_item", "customer_visits", "customer_totals"])
    assert all(_plan(df).count("Exchange") == 1 for df in made.values())
    assert sorted(map(str, wh.customer_metrics().collect())) == sorted(map(str, facts.customer_metrics(wh.fact()).collect()))


def test_hot_customers_are_not_dealt_to_one_task(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warehouse, "HOT_ROWS", 100)
    monkeypatch.setattr(warehouse, "HOT_SHARE", 10)
    fact = session.written(_bought(spark), "test-hot")
    assert set(warehouse.hot_customers(fact)) == {7, None}
    names = ["customer_item", "customer_visits", "customer_totals"]
    made, dealt = warehouse._customer_states(fact, names)
    for name in names:
        plain = warehouse.STATES[name][3](fact)
        assert made[name].schema == plain.schema and sorted(map(str, made[name].collect())) == sorted(map(str, plain.collect())), name
    assert dealt.filter("customer_id IS NULL OR customer_id = 7").isEmpty() and dealt.count() == 585
    monkeypatch.setattr(warehouse, "HOT_ROWS", 5000)
    assert warehouse.hot_customers(fact) == []
    monkeypatch.setattr(warehouse, "HOT_ROWS", 100)
    wh = warehouse.write_processed(spark, fact, str(tmp_path / "wh"))
    assert sorted(map(str, wh.customer_metrics().collect())) == sorted(map(str, facts.customer_metrics(wh.fact()).collect()))


def test_transactions_are_dealt_once_for_what_counts_them(spark, tmp_path, monkeypatch):
    """Also with hot transactions, whose rows are not dealt: 77 and null have 200 rows each."""
    monkeypatch.setattr(warehouse, "HOT_ROWS", 100)
    monkeypatch.setattr(warehouse, "HOT_SHARE", 10)
    tid = F.expr("CASE WHEN transaction_id BETWEEN 10 AND 76 THEN 77 WHEN transaction_id < 180 AND transaction_id > 100 THEN NULL ELSE transaction_id END")
    fact = session.written(_bought(spark).withColumn("transaction_id", tid), "test-hot-transactions")
    assert set(warehouse.hot_keys(fact, "transaction_id")) == {77, None}
    plain = {name: facts.transaction_metrics(fact) if name == "transaction_metrics" else warehouse.STATES[name][3](fact) for name in warehouse.OF_TRANSACTIONS}
    want = {name: sorted(map(str, df.collect())) for name, df in plain.items()}
    for most in (100, 5000):
        monkeypatch.setattr(warehouse, "HOT_ROWS", most)
        made, dealt = warehouse._transaction_states(fact, list(warehouse.OF_TRANSACTIONS))
        assert dealt.filter("transaction_id IS NULL OR transaction_id = 77").isEmpty() == (most == 100)
        for name, df in made.items():
            assert df.dtypes == plain[name].dtypes and sorted(map(str, df.collect())) == want[name], name
    made, _ = warehouse._transaction_states(fact, list(warehouse.OF_TRANSACTIONS))  # plans that have not run
    assert {name: _plan(df).count("Exchange") for name, df in made.items()} == {"transaction_metrics": 1, "product_totals": 2, "category_totals": 2}
    shared = _plan(made["product_totals"])
    assert "hashpartitioning(transaction_id" in shared and "hashpartitioning(product_id" in shared and "hashpartitioning(product_id, transaction_id" not in shared.replace("#", "")
    wh = warehouse.write_processed(spark, fact, str(tmp_path / "wh"))
    assert sorted(map(str, wh.transaction_metrics().select(*plain["transaction_metrics"].columns).collect())) == want["transaction_metrics"]


def test_an_append_builds_no_warehouse_of_all_orders(spark, tmp_path):
    """Only the tables an append publishes are written, and text only of the orders it uploads."""
    from tillroll.plans import maintenance
    spark.range(0, 60, 1, 2).select(F.col("id").alias("o_orderkey"), F.expr("date_add(DATE'1997-12-20', cast(id AS INT))").alias("o_orderdate"),
                                    F.lit("1-X").alias("o_orderpriority"), (F.col("id") % 7).alias("o_custkey")).write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(0, 120, 1, 2).select(F.expr("id div 2").alias("l_orderkey"), F.expr("cast(id % 2 + 1 AS INT)").alias("l_linenumber"), (F.col("id") % 5).alias("l_partkey"),
                                     F.lit(2.0).alias("l_quantity")).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(5).select(F.col("id").alias("p_partkey"), F.concat(F.lit("Brand#1"), F.col("id").cast("string")).alias("p_brand")).write.parquet(f"{tmp_path}/part.parquet")
    got = {r["product_id"]: r["total_quantity"] for r in maintenance.q_append_publish_products(spark, str(tmp_path)).collect()}
    assert got == {i: 48 for i in range(5)}
    assert not any(sf == str(tmp_path) for _, sf in warehouse._BUILT)
    batch, every = maintenance._new_batch(spark, str(tmp_path)), testdata.part_basket_strings(spark, str(tmp_path))
    assert "LeftSemi" in _plan(batch) and sorted(batch.collect()) == sorted(every.filter("date >= DATE'1998-01-01'").collect())
    assert batch.count() == 48
