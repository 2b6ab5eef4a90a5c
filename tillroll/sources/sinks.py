"""Sinks: processed Parquet tables, CSV exports, storage report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def export_csv(df: DataFrame, path: str) -> None:
    """CSV with a header line (segments, profiles, recommendations)."""
    df.write.mode("overwrite").option("header", True).csv(path)


def read_csv_export(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def storage_report(spark: SparkSession, root: str, tables) -> DataFrame:
    """Size in MB and file count of each table directory under ``root``.

    Uses the binaryFile listing with the content column pruned, so no data
    file is opened.
    """
    out = None
    for t in tables:
        d = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
                  .option("pathGlobFilter", "*.parquet").load(f"{root.rstrip('/')}/{t}")
                  .agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))
                  .select(F.lit(t).alias("table"), "files", (F.col("bytes") / (1024 * 1024)).alias("size_mb")))
        out = d if out is None else out.unionByName(d)
    return out
