"""Exact dedup by a heavy-hitter split.

Frequent digests are found by Spark's Misra-Gries style aggregate
(``freqItems``: a counter table of 1/support entries per task that merges), so
every digest above the support is among them and no more than 1/support are.
Their winners are then verified exactly with map-side combining and joined to
the rows as a broadcast table of at most 1/support rows: copies of a hot text
never travel. All other digests (each below support x rows) are shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from .shared import SPACES, named, private, stored

COLUMNS = ["keep_id", "group_size", "kept", "text_sha256"]


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES + "+", "")


def _winner(prefix: str = "") -> Column:
    """Most code points, then the smallest id (a null id before all others)."""
    return F.min(F.struct((-F.col(prefix + "points")).alias("order"), F.col(prefix + "id").alias("id")))["id"]


def exact_groups(rows: DataFrame, support: float = 1 / 1024) -> DataFrame:
    """rows: (id, digest binary, points long). Adds keep_id and group_size.

    The broadcast side has at most ceil(1/support) + 1 rows of about 60 bytes
    whatever the input, which is its proven bound.
    """
    frequent = rows.stat.freqItems(["digest"], support).select(F.explode("digest_freqItems").alias("digest"))
    bound = math.ceil(1 / support) + 1
    heavy = (
        rows.join(F.broadcast(frequent), "digest", "left_semi")
        .groupBy("digest").agg(_winner().alias("keep_id"), F.count("*").alias("group_size"))
        .orderBy("digest").limit(bound)  # no more rows than freqItems can name
    )
    heavy = stored(heavy, "exact-heavy")
    flagged = rows.join(F.broadcast(heavy.withColumn("hot", F.lit(True))), "digest", "left")
    hot = flagged.filter("hot").drop("hot")
    group = Window.partitionBy("digest")
    cold = (
        flagged.filter("hot IS NULL").drop("hot", "keep_id", "group_size")
        .withColumn("keep_id", F.min(F.struct((-F.col("points")).alias("order"), F.col("id").alias("id"))).over(group)["id"])
        .withColumn("group_size", F.count("*").over(group))
    )
    return hot.unionByName(cold)


def exact_dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", support: float = 1 / 1024) -> DataFrame:
    """One row per input row: id_col, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are the same without ASCII whitespace; of equal
    texts the row with the most code points, then the smallest id stays.

    Nulls: a null text counts as empty (all empty texts are equal); a null id
    sorts before other ids and ``keep_id`` is then null. Repeated rows: every
    row of the winning id that has the winner's text is ``kept``. An empty
    table gives an empty result. Extra columns are ignored, whatever their name.
    """
    text = named(text_col)
    rows = docs.select(
        named(id_col).alias("id"),
        F.unhex(F.sha2(normalised(text), 256)).alias("digest"),
        F.length(F.coalesce(text, F.lit(""))).cast("long").alias("points"),
    )
    groups = exact_groups(stored(rows, "exact-digests"), support)
    return groups.select(
        F.col("id").alias(id_col), "keep_id", "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_first(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The input's rows that stay, with all their columns (one called group_size
    is replaced). A row is known by its id and its text, so that another text
    under a winner's id neither stays nor goes with it."""
    own = private(docs.columns)
    keep = [c for c in docs.columns if c.lower() != "group_size"]
    kept = exact_dedup(docs, text_col, id_col).filter("kept").select(named(id_col).alias(own + "id"), F.unhex("text_sha256").alias(own + "of"), F.col("group_size").alias(own + "size")).distinct()
    rows = docs.select(*map(named, keep), F.unhex(F.sha2(normalised(named(text_col)), 256)).alias(own + "digest"), named(id_col).alias(own + "doc"))
    same = (F.col(own + "digest") == F.col(own + "of")) & F.col(own + "doc").eqNullSafe(F.col(own + "id"))
    return rows.join(kept, same).select(*map(named, keep), F.col(own + "size").alias("group_size"))
