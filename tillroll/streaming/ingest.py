"""Stream new ``<store>_Tran.csv`` files into the processed fact.

Each micro-batch holds whole files (the file source never splits a file across
batches). Its lines are landed like those of a batch load and go through the same
reading, gate and rejection (``sources.files``), so any layout that a rebuild
accepts is accepted here and what it refuses is refused for the same reason. Every
epoch writes

* ``<fact_path>/batch_id=<epoch>``: its fact rows,
* ``<report_path>/gate/batch_id=<epoch>``: the report of its files,
* ``<report_path>/rejected/batch_id=<epoch>``: the rows that can't be used,
* ``<report_path>/files/batch_id=<epoch>``: the files it took in,

each with overwrite, so a batch that is run again after a failure replaces its own
output: the ingestion is exactly-once. Files that earlier epochs took in are the
state across batches, by path and by content (lines and the sum of their hashes):
one that is delivered again under another name, or under its old one once the file
source has forgotten that, is not counted twice but reported. Transaction ids carry the epoch and the line's number in its source.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession, functions as F

from tillroll.operators.baskets import build_fact, expand_baskets
from tillroll.plans.rebuild import raw_batch
from tillroll.plans.warehouse import by_month
from tillroll.session import lookup_table, written
from tillroll.sources import files

AGAIN = "taken in by an earlier batch"


def contents(landed: DataFrame) -> DataFrame:
    """A row per file: lines and the sum of their hashes, whatever their order."""
    return landed.groupBy("file_path").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.xxhash64("value").cast("decimal(38,0)")).alias("digest"))


def spread(lines: DataFrame) -> DataFrame:
    """Numbered lines dealt to as many tasks as the cluster runs at a time. A batch of two
    compressed files is read by two tasks; cutting and expanding its lines need not be
    left to those. ``pos`` was given before, so that numbers are those of the files."""
    return lines.repartition(lines.sparkSession.sparkContext.defaultParallelism, "pos")


def taken_in(spark: SparkSession, report_path: str, before: int | None = None) -> DataFrame:
    """(file_path, lines, digest, batch_id) of the files taken in so far, or before an epoch."""
    root = f"{report_path.rstrip('/')}/files"
    found = spark.read.schema("file_path string, lines bigint, digest decimal(38,0), batch_id int").option("basePath", root).parquet(f"{root}/batch_id=*")
    return found if before is None else found.filter(F.col("batch_id") < before)


def ingest_stream(spark: SparkSession, raw_dir: str, product_category: DataFrame, categories: DataFrame,
                  fact_path: str, checkpoint: str, max_files_per_trigger: int = 16, report_path: str | None = None):
    """Start an availableNow stream; returns the StreamingQuery. The catalogues are stored
    as they are at its start, for all of its batches."""
    report_path = (report_path or f"{fact_path.rstrip('/')}-report").rstrip("/")
    products = lookup_table(product_category.select("product_id", "category_id"), "stream-products")
    names_of = lookup_table(categories.select("category_id", "category_name"), "stream-categories")
    src = files.with_source(spark.readStream.option("maxFilesPerTrigger", max_files_per_trigger).text(f"{raw_dir.rstrip('/')}/*_Tran.csv"))

    def put(job: tuple) -> None:
        df, root, epoch, *by = job
        df.write.mode("overwrite").partitionBy(*by).parquet(f"{root.rstrip('/')}/batch_id={epoch}")

    def per_batch(batch: DataFrame, epoch: int):
        landed = written(spread(files.numbered(batch)), "stream-landing")
        names = written(contents(landed), "stream-files")
        before = taken_in(spark, report_path, epoch) if epoch else names.limit(0)
        new = names.join(before.select("file_path"), "file_path", "left_anti").join(before.select("lines", "digest"), ["lines", "digest"], "left_anti")
        again = written(names.join(new.select("file_path"), "file_path", "left_anti").select("file_path"), "stream-again")
        rows, report = files.gated(landed.join(again, "file_path", "left_anti"))
        refused = again.select(
            F.regexp_extract("file_path", files.SOURCE_PATTERN, 1).alias("source"), files.store_of_file().alias("file_store"),
            *[F.lit(0).cast("bigint").alias(c) for c in ("rows", "foreign_rows", "bad_dates", "bad_customer_ids")], F.lit(True).alias("layout_ok"),
            F.array().cast("array<string>").alias("missing_columns"), F.lit(AGAIN).alias("reason"), F.lit(False).alias("accepted")).distinct()
        raw = raw_batch(rows, f"b{epoch}").filter(F.col("date").isNotNull() & F.col("customer_id").isNotNull())
        fact = by_month(build_fact(expand_baskets(raw), products, names_of))
        took = names.join(rows.select("file_path").distinct(), "file_path", "left_semi")
        # independent of each other; a batch that is run again writes all of them again
        with ThreadPoolExecutor(4) as pool:
            list(pool.map(put, [(fact, fact_path, epoch, "year", "month"), (report.unionByName(refused), f"{report_path}/gate", epoch),
                                (files.rejected_rows(rows), f"{report_path}/rejected", epoch), (took, f"{report_path}/files", epoch)]))

    return (src.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
               .trigger(availableNow=True).start())
