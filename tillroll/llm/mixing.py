"""Mixing sources to target weights.

Every document gets a hash-random key. Because the keys are uniform, fixed key
ranges cut each source into even runs without sampling: sizes are summed per
(source, range), the sums are accumulated within each source, and only the one
range in which a source's budget ends is sorted row by row. Whole ranges before
it are taken, ranges after it are not. A source that holds most of the rows is
cut into as many ranges as any other, and no text is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .shared import WORD, named, parallelism, private, stored, without

MAX_EPOCHS = 3
CYCLE = (1, 2, 3)
COLUMNS = ["size", "source_size", "target", "taken"]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_mark(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")))


def cycle_weights(sizes: DataFrame, cycle: tuple[int, ...] = CYCLE) -> DataFrame:
    """sizes: (source, source_size), one row per source. Weights repeat over the
    sources in code point order, null last."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(order) - 1
    return sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, cycle)), (rank % len(cycle) + 1).cast("int")))


def fill_targets(weighted: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """weighted: (source, source_size, weight). Adds target: the sources share
    all sizes by weight; a target stops at max_epochs times its source's size
    and the excess goes to the others by weight, until none is above.

    With sources in order of cap / weight those that stop are a prefix: the
    share per weight after k stopped sources is (all - their caps) / (weight
    left), and source k + 1 stops if its own cap per weight is not above that.
    From the first that does not stop on, that level only falls: the largest
    level of those that don't stop is the share.
    """
    per = F.col("cap") / F.col("weight")
    order = Window.orderBy("per", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    x = (
        weighted.filter("weight > 0").withColumn("cap", max_epochs * F.col("source_size")).withColumn("per", per)
        .withColumn("total", F.sum("source_size").over(every))
        .withColumn("caps", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("left", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("level", F.greatest(F.col("total") - F.col("caps"), F.lit(0)) / F.col("left"))
        .withColumn("full", F.col("per") <= F.col("level"))
        .withColumn("share", F.max(F.when(~F.col("full"), F.col("level"))).over(every))
    )
    target = F.when(F.col("full") | F.col("share").isNull(), F.col("cap").cast("double")).otherwise(F.col("share") * F.col("weight"))
    return x.select("source", "source_size", target.cast("double").alias("target"))


def mix(docs: DataFrame, weights: DataFrame | None = None, *, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source", size: Column | None = None, mark: Column | None = None, seed: int = 17, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """docs with size, source_size, target and taken (words that the mix takes;
    repeats counted), one row per input row, dropped rows with taken = 0.

    weights: (source, weight) or None for the repeating 1, 2, 3. Whole epochs
    are taken first; in the last, partial epoch documents are taken in key
    order up to the source's budget, the one that crosses it in part.

    mark tells rows of one id apart, by default a hash of the text. Nulls: a null
    text has size 0, a null source is a source of its own, a row without an id
    gets its key from its mark. Ties: equal keys are ordered by size and mark, and
    rows that agree in all are interchangeable. An empty table gives no rows.
    Input columns called like a result column are replaced.
    """
    spark = docs.sparkSession
    ranges = 1 << max(6, (4 * parallelism(spark) - 1).bit_length())
    size = word_count(named(text_col)) if size is None else size
    mark = text_mark(named(text_col)) if mark is None else mark
    key = F.md5(F.concat_ws(":", F.coalesce(named(id_col).cast("string"), F.concat(F.lit(":"), mark)), F.lit(str(seed))))
    own = private(docs.columns)
    kept = [named(c) for c in docs.columns if c.lower() not in COLUMNS]
    base = docs.select(*kept, named(source_col).alias(own + "source"), key.alias(own + "key"), size.alias(own + "size"), mark.alias(own + "mark"))
    base = base.withColumn(own + "range", (F.conv(F.substring(own + "key", 1, 8), 16, 10).cast("long") * ranges / 2**32).cast("int"))

    sums = stored(base.groupBy(F.col(own + "source").alias("source"), F.col(own + "range").alias("range")).agg(F.sum(own + "size").alias("words")), "mix-ranges")
    sizes = sums.groupBy("source").agg(F.sum("words").alias("source_size"))
    if weights is None:
        weighted = cycle_weights(sizes)
    else:
        weighted = sizes.join(weights.select("source", "weight"), sizes["source"].eqNullSafe(weights["source"]), "left").select(sizes["source"], "source_size", F.coalesce("weight", F.lit(0)).alias("weight"))
    plan = fill_targets(weighted, max_epochs)
    budget = F.least(F.round("target").cast("long"), max_epochs * F.col("source_size"))
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    plan = stored(plan.withColumn("epochs", whole.cast("long")).withColumn("rest", budget - F.col("epochs") * F.col("source_size")), "mix-plan")

    # where each source's partial epoch ends: (source, first range not taken whole, words left for it)
    run = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    p = plan.select(F.col("source").alias("p_source"), "source_size", "target", "epochs", "rest")
    cuts = (
        sums.withColumn("before", F.coalesce(F.sum("words").over(run), F.lit(0)))
        .join(p, F.col("source").eqNullSafe(F.col("p_source")))
        .filter("before + words > rest")
        .groupBy("source").agg(F.min(F.struct("range", "before")).alias("cut"))
        .select(F.col("source").alias("c_source"), F.col("cut.range").alias("cut_range"), F.col("cut.before").alias("cut_before"))
    )
    plan = stored(p.join(cuts, F.col("p_source").eqNullSafe(F.col("c_source")), "left").drop("c_source"), "mix-cuts")

    plan = plan.toDF(*[own + c for c in plan.columns])
    col = lambda name: F.col(own + name)
    rows = base.join(plan, col("source").eqNullSafe(col("p_source")), "left").withColumn(
        own + "place", F.when(col("cut_range").isNull() | (col("range") < col("cut_range")), -1).when(col("range") > col("cut_range"), 1).otherwise(0))
    outside = rows.filter(col("place") != 0).withColumn(own + "part", F.when(col("place") < 0, col("size")).otherwise(0))
    order = Window.partitionBy(own + "source", own + "range").orderBy(own + "key", own + "size", own + "mark").rowsBetween(Window.unboundedPreceding, -1)
    left = col("rest") - col("cut_before") - F.coalesce(F.sum(own + "size").over(order), F.lit(0))
    inside = rows.filter(col("place") == 0).withColumn(own + "part", F.least(F.greatest(left, F.lit(0)), col("size")))
    out = outside.unionByName(inside)
    taken = F.when(col("source_size").isNull(), 0).otherwise(col("epochs") * col("size") + col("part")).cast("long")
    return out.select(*kept, col("size").alias("size"), F.coalesce(col("source_size"), F.lit(0)).cast("long").alias("source_size"),
                      F.coalesce(col("target"), F.lit(0.0)).alias("target"), taken.alias("taken"))


def mixture(docs: DataFrame, weights: DataFrame | None = None, **options) -> DataFrame:
    """The mixed corpus itself: each document's columns, ``taken`` and
    ``epoch`` (1, 2, ...), one row for each time it is taken; the text of a
    copy that the budget cuts ends after its last taken word."""
    text = options.get("text_col", "text")
    rows = mix(docs, weights, **options).filter("taken > 0")
    copies = F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))
    rows = without(rows, ["epoch"]).withColumn("epoch", F.explode(copies))
    words = F.col("taken") - (F.col("epoch") - 1) * F.col("size")
    cut = F.array_join(F.slice(F.regexp_extract_all(named(text), F.lit(f"({WORD})"), F.lit(1)), 1, words.cast("int")), " ")
    return rows.withColumn(text, F.when(words < F.col("size"), cut).otherwise(named(text)))
