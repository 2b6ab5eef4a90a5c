"""URL filters: a sorted sweep of urls and rules over reversed-host keys.

A rule is a host and a path; it fits the urls of its host and of all subdomains
whose path starts with the rule's path. Written with its labels reversed
(``www.example.com`` as ``com.example.www.``), a host comes before all its
subdomains, so a rule's hosts are an interval of the sorted keys, and so are the
paths that start with the rule's path. Rules' intervals contain one another or
are disjoint.

``innermost`` sweeps points and interval ends in sorted order. The stack of open
rules is kept by depth: a running sum of starts and ends is the stack's height,
and the rule on top at height h is the last one that was opened to height h.
Points and ends are dealt by ranges of the key; what is open where a range
begins follows from the ranges' own sums and from the last rule opened at each
height, a table of ranges times heights.

The sweep runs over the distinct hosts, which gives each host its stack of rule
hosts, and then over (rule host, path). Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .shared import named, parallelism, stored, without

UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OPEN, POINT, CLOSE = 0, 1, 2
OUTPUT = ("host", "path", "rule", "verdict")


def lowered(c: Column) -> Column:
    return F.translate(c, UPPER, LOWERED)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: from the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z lowered;
    path: from there to ``?``, ``#`` or the end. Both are empty without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return lowered(F.regexp_extract(rest, "^([^/?#]*)", 1)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    """Labels in reversed order, each closed by a dot; empty for an empty host."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit(".")))


def innermost(points: DataFrame, rules: DataFrame) -> DataFrame:
    """For each point the longest rule of its group that its key starts with.

    points: (grp, key, tag), strings, none null; rules: (grp, key, what), a row
    for each (grp, key), ``what`` not null. Returns (grp, key, tag, what), the
    last null where no rule fits. Equal keys are told apart by their tag when
    points are dealt to ranges, so one key may have any number of points.
    """
    spark = points.sparkSession
    at = F.col("key").cast("binary")
    none = F.lit(None).cast(rules.schema["what"].dataType)
    opened = rules.select("grp", at.alias("at"), F.lit(OPEN).alias("kind"), F.lit("").alias("tag"), F.col("what"), F.lit(1).alias("step"))
    # no byte of a text is FF: this lies behind every key that starts with the rule's
    closed = rules.select("grp", F.concat(at, F.unhex(F.lit("FF"))).alias("at"), F.lit(CLOSE).alias("kind"), F.lit("").alias("tag"), none.alias("what"), F.lit(-1).alias("step"))
    looked = points.select("grp", at.alias("at"), F.lit(POINT).alias("kind"), "tag", none.alias("what"), F.lit(0).alias("step"))
    events = looked.unionByName(opened).unionByName(closed)
    place = ["grp", "at", "kind"]
    dealt = stored(events.repartitionByRange(parallelism(spark), *place, "tag").withColumn("shard", F.spark_partition_id()), "url-sweep")

    # heights where the ranges begin: a row for each range
    sums = dealt.groupBy("shard").agg(F.sum("step").alias("net"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    begins = stored(sums.select("shard", F.coalesce(F.sum("net").over(before), F.lit(0)).alias("height")), "url-shards")
    # the last rule opened to each height within a range
    ends = dealt.filter(F.col("kind") != POINT).join(begins, "shard")
    so_far = Window.partitionBy("shard").orderBy(*place).rowsBetween(Window.unboundedPreceding, 0)
    lifted = ends.withColumn("depth", F.col("height") + F.sum("step").over(so_far)).filter(F.col("kind") == OPEN)
    last = lifted.groupBy("shard", "depth").agg(F.max_by("what", F.struct("grp", "at")).alias("what"))
    # and before it: a row for each range and height that is open where it begins
    wanted = begins.filter("height > 0").select("shard", F.explode(F.sequence(F.lit(1).cast("long"), "height")).alias("depth"), F.lit(True).alias("wanted"))
    earlier = Window.partitionBy("depth").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.join(wanted, ["shard", "depth"], "full").withColumn("what", F.last("what", ignorenulls=True).over(earlier)).filter("wanted")

    front = carried.select(F.lit("").alias("grp"), F.lit(b"").alias("at"), F.lit(OPEN).alias("kind"), F.lit("").alias("tag"), "what", F.lit(1).alias("step"), "shard", F.col("depth").alias("turn"))
    swept = dealt.withColumn("turn", F.lit(2**62)).unionByName(front)
    order = ["turn", *place]
    swept = swept.withColumn("depth", F.sum("step").over(Window.partitionBy("shard").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    stack = Window.partitionBy("shard", "depth").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    top = swept.filter(F.col("kind") != CLOSE).withColumn("top", F.last("what", ignorenulls=True).over(stack))
    return top.filter(F.col("kind") == POINT).select(
        "grp", F.col("at").cast("string").alias("key"), "tag", F.when(F.col("depth") > 0, F.col("top")).alias("what"))


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", columns: list[str] | None = None) -> DataFrame:
    """The rows of ``pages`` with host, path, rule and verdict of their url.

    rules: (host, path, verdict). Of the rules that fit a url the one whose host
    and path have the most code points together holds, of equal lengths the one
    with the longer host. ``rule`` is its host and path in one string, null where
    none fits; then the verdict is ``default``.

    A null url, or one without ``://``, has an empty host and path, which only a
    rule with an empty host and path fits; an empty host stands for all hosts.
    Rules without host, path or verdict are left out; a rule given several times
    holds with the largest of its verdicts (block before allow). Rows are
    returned as often as they occur, in any case with the columns ``columns``
    (all, if not given); columns called like the results are replaced. An empty
    ``pages`` gives an empty result; without rules every verdict is the default.
    Only distinct hosts and paths are swept and joined back, so a url of a third
    of all rows is one point.
    """
    kept = [c for c in without(pages, list(OUTPUT)).columns if columns is None or c in columns]
    host, path = host_and_path(named(url).cast("string"))
    rows = pages.select(F.struct(*(map(named, kept) if kept else [F.lit(0)])).alias("row"), host.alias("host"), path.alias("path"))
    given = rules.select(lowered(F.col("host")).alias("host"), "path", "verdict").dropna()
    given = stored(given.groupBy("host", "path").agg(F.max("verdict").alias("verdict")).withColumn("grp", host_key(F.col("host"))), "url-rules")
    urls = stored(rows.select("host", "path").distinct(), "urls")

    # each host's innermost rule host, and the rule hosts around that
    hosts = urls.select("host").distinct().select(F.lit("").alias("grp"), host_key(F.col("host")).alias("key"), F.col("host").alias("tag"))
    rule_hosts = given.select("grp").distinct()
    found = innermost(hosts, rule_hosts.select(F.lit("").alias("grp"), F.col("grp").alias("key"), F.col("grp").alias("what")))
    found = stored(found.filter(F.col("what").isNotNull()).select(F.col("tag").alias("host"), F.col("what").alias("inner")), "url-hosts")
    labels = F.split("inner", r"\.", -1)
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.when(k == 1, F.lit("")).otherwise(
        F.concat(F.array_join(F.slice(labels, F.lit(1), k - 1), "."), F.lit("."))))
    chain = found.select("inner").distinct().select("inner", F.explode(F.array_distinct(above)).alias("grp")).join(rule_hosts, "grp", "left_semi")

    points = urls.join(found, "host").join(chain, "inner").select("grp", F.col("path").alias("key"), F.col("host").alias("tag"))
    what = F.struct(F.length(F.concat("host", "path")).alias("size"), F.length("host").alias("hosts"), F.concat("host", "path").alias("rule"), "verdict")
    fits = innermost(points, given.select("grp", F.col("path").alias("key"), what.alias("what"))).filter(F.col("what").isNotNull())
    best = fits.groupBy(F.col("tag").alias("host"), F.col("key").alias("path")).agg(F.max("what").alias("best"))
    out = rows.join(best, ["host", "path"], "left")
    return out.select(*[F.col("row").getField(c).alias(c) for c in kept], "host", "path", F.col("best.rule").alias("rule"),
                      F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules given in code, as the table that filter_urls takes."""
    return spark.createDataFrame(rules, "host string, path string, verdict string")
