"""Connected components of an edge table by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .shared import stored


def connected(edges: DataFrame, name: str = "components") -> DataFrame:
    """edges: (u, v). Returns (node, root): root is the same for connected
    nodes; nodes without an edge are not listed.

    Each round points every node at its smallest neighbour (if that is smaller),
    follows two pointers, and carries the edges over to the nodes pointed at;
    edges within one node vanish. Rounds are written to the shared folder.
    """
    both = edges.select("u", "v").filter("u <> v")
    both = stored(both.union(both.select("v", "u")).distinct(), name)
    found = both.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct()
    while not both.isEmpty():
        up = stored(both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("up")), name)
        twice = stored(up.select(F.col("u").alias("w"), F.col("up").alias("u")).join(up, "u").select(F.col("w").alias("u"), "up"), name)
        found = stored(found.join(twice.withColumnRenamed("u", "root"), "root", "left").select("node", F.coalesce("up", "root").alias("root")), name)
        half = both.join(twice, "u").select(F.col("up").alias("a"), F.col("v").alias("u"))
        both = stored(half.join(twice, "u").select(F.col("a").alias("u"), F.col("up").alias("v")).filter("u <> v").distinct(), name)
    return found
