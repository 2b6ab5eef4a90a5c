"""Exact quantiles without a per-group buffer in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tillroll.session import scratch_path


def quantiles(df: DataFrame, value: str, probs: list[float], group: str | None = None) -> DataFrame:
    """([group,] q): the linear-interpolated quantiles ``probs`` of the non-null
    values, as an array; one row per group (a null group is one), none for a
    group without values.

    Equal values are counted first, so a frequent value is one row. The counts
    are written once, sorted by ranges of (group, value); running totals of the
    ranges tell which of them hold a wanted rank, and only those are ranked.
    """
    g = F.col(group) if group else F.lit(0)
    counts = (df.select(g.alias("_g"), F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
                .groupBy("_g", "_v").agg(F.count(F.lit(1)).alias("_n")))
    path = scratch_path(df.sparkSession, "quantiles")
    (counts.repartitionByRange("_g", "_v").withColumn("_part", F.spark_partition_id())
           .write.parquet(path))
    counts = df.sparkSession.read.parquet(path)

    every = Window.partitionBy("_g")
    ranges = counts.groupBy("_g", "_part").agg(F.sum("_n").alias("_size"))  # a row per group and range
    ranges = ranges.select(
        F.col("_g").alias("_rg"), F.col("_part").alias("_rp"), "_size", F.sum("_size").over(every).alias("_total"),
        (F.sum("_size").over(every.orderBy("_part")) - F.col("_size")).alias("_before"))
    ranks = [(F.floor((F.col("_total") - 1) * F.lit(p)), F.ceil((F.col("_total") - 1) * F.lit(p))) for p in probs]

    def holds(rank, start, size):
        return (rank >= start) & (rank < start + size)

    wanted = F.lit(False)
    for lo, hi in ranks:
        wanted |= holds(lo, F.col("_before"), F.col("_size")) | holds(hi, F.col("_before"), F.col("_size"))
    rows = counts.join(ranges.filter(wanted), F.col("_g").eqNullSafe(F.col("_rg")) & (F.col("_part") == F.col("_rp")))
    seen = F.sum("_n").over(Window.partitionBy("_g", "_part").orderBy("_v"))
    rows = rows.withColumn("_start", F.col("_before") + seen - F.col("_n"))
    picks = []
    for p, (lo, hi) in zip(probs, ranks):
        at = [F.max(F.when(holds(r, F.col("_start"), F.col("_n")), F.col("_v"))) for r in (lo, hi)]
        share = F.max((F.col("_total") - 1) * F.lit(p) - lo)
        picks.append(at[0] + (at[1] - at[0]) * share)
    out = rows.groupBy("_g").agg(F.array(*picks).alias("q"))
    return out.select(F.col("_g").alias(group), "q") if group else out.select("q")
