"""Distribution statistics: correlation, box statistics, outliers, histogram, scatter."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tillroll.operators.quantiles import quantiles

DEFAULT_CORR_FEATURES = ["frequency", "recency", "total_quantity",
                         "unique_products", "unique_categories", "avg_basket_size"]


def correlation_matrix(df: DataFrame, features: list[str] | None = None) -> DataFrame:
    """Pearson correlation of every feature pair in long form (x, y, corr).

    One aggregation pass computes all pair covariances and deviations. A pair
    with a constant column gives null (F.corr would raise under ANSI).
    """
    feats = [f for f in (features or DEFAULT_CORR_FEATURES) if f in df.columns]
    aggs = []
    for f in feats:
        aggs.append(F.stddev_pop(F.col(f).cast("double")).alias(f"sd__{f}"))
    pairs = [(a, b) for i, a in enumerate(feats) for b in feats[i:]]
    for a, b in pairs:
        aggs.append(F.covar_pop(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"cov__{a}__{b}"))
    one = df.agg(*aggs)
    entries = []
    for a, b in pairs:
        den = F.col(f"sd__{a}") * F.col(f"sd__{b}")
        c = F.when(den > 0, F.col(f"cov__{a}__{b}") / den)
        entries.append(F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), c.alias("corr")))
        if a != b:
            entries.append(F.struct(F.lit(b).alias("x"), F.lit(a).alias("y"), c.alias("corr")))
    return one.select(F.inline(F.array(*entries)))


def box_stats(df: DataFrame, value: str, group: str | None = None) -> DataFrame:
    """Quartiles (linear interpolation), 1.5 IQR fences, mean, sample sd, extremes."""
    x = F.col(value).cast("double")
    g = df.groupBy(group) if group else df.groupBy()
    s = g.agg(F.count(x).alias("count"), F.avg(x).alias("mean"),
              F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"))
    q = quantiles(df, value, [0.25, 0.5, 0.75], group)
    keys = [group] if group else []
    if group:
        q = q.select(F.col(group).alias("_group"), F.col("q").alias("_q"))
        s = s.join(q, F.col(group).eqNullSafe(F.col("_group")), "left")
    else:
        s = s.select("*", q.select("q").scalar().alias("_q"))
    q1, q3 = F.col("_q")[0], F.col("_q")[2]
    return s.select(*keys, "count", q1.alias("q1"), F.col("_q")[1].alias("median"), q3.alias("q3"),
                    (q3 - q1).alias("iqr"), (q1 - 1.5 * (q3 - q1)).alias("lower_fence"),
                    (q3 + 1.5 * (q3 - q1)).alias("upper_fence"), "mean", "std", "min", "max")


def outliers(df: DataFrame, value: str, group: str | None = None) -> DataFrame:
    """Rows outside the 1.5 IQR fences of their group (or of the whole table)."""
    stats = box_stats(df, value, group)
    x = F.col(value).cast("double")
    if group:
        j = df.join(stats.select(group, "lower_fence", "upper_fence"), group)
        return j.filter((x < F.col("lower_fence")) | (x > F.col("upper_fence"))).drop("lower_fence", "upper_fence")
    fences = stats.select(F.struct("lower_fence", "upper_fence")).scalar()
    return df.filter((x < fences["lower_fence"]) | (x > fences["upper_fence"]))


def histogram(df: DataFrame, value: str, bins: int = 30) -> DataFrame:
    """Equal-width bins between min and max, last bin closed, empty bins as 0."""
    x = F.col(value).cast("double")
    bounds = df.select(F.struct(F.min(x).alias("lo"), F.max(x).alias("hi"))).scalar()
    lo, hi = bounds["lo"], bounds["hi"]
    width = hi - lo
    b = F.when(width > 0, F.least(F.floor((x - lo) / width * bins), F.lit(bins - 1))).otherwise(0)
    counts = df.filter(x.isNotNull()).groupBy(b.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    spine = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return spine.join(counts, "bin", "left").select(
        "bin", (lo + width * F.col("bin") / bins).alias("bin_start"),
        (lo + width * (F.col("bin") + 1) / bins).alias("bin_end"),
        F.coalesce("count", F.lit(0)).alias("count"))


def scatter(df: DataFrame, x: str, y: str, color: str | None = None, size: str | None = None,
            key: str | None = None) -> DataFrame:
    cols = ([key] if key else []) + [F.col(x).alias("x"), F.col(y).alias("y")]
    if color:
        cols.append(F.col(color).alias("color"))
    if size:
        cols.append(F.col(size).alias("size"))
    return df.select(*cols)
