"""Distinct counts that merge: exact bitmaps of ids.

A bitmap of ids is kept in pages of 32,768 bits, one row a page: who bought on a
day in a store, what was bought in a category. Pages of several days, stores or
batches are joined by a bitwise or, so distinct customers of any date range or
store follow without the fact. Ids are whole numbers; a page costs 4 KB however
few of its bits are set, so ids should be dense (numbers given out in order, as
customer and product numbers are).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

ENTITIES = {"customer": "customer_id", "product": "product_id", "category": "category_id"}


def pages(rows: DataFrame, by: list[str], entities=("customer", "product", "category")) -> DataFrame:
    """(*by, entity, page, bits): the ids that stand with each value of ``by``."""
    def one(entity):
        c = F.col(ENTITIES[entity]).cast("bigint")
        part = rows.filter(c.isNotNull())
        return part.groupBy(*by, F.lit(entity).alias("entity"), F.bitmap_bucket_number(c).alias("page")).agg(
            F.bitmap_construct_agg(F.bitmap_bit_position(c)).alias("bits"))
    return reduce(DataFrame.unionByName, [one(e) for e in entities])


def count_members(members: DataFrame, by: list[str], entity: str, name: str) -> DataFrame:
    """Distinct ids of an entity per value of ``by`` (a subset of the pages' keys)."""
    merged = members.filter(F.col("entity") == entity).groupBy(*by, "page").agg(F.bitmap_or_agg("bits").alias("bits"))
    return merged.groupBy(*by).agg(F.sum(F.bitmap_count("bits")).alias(name))


def count_all(members: DataFrame, entity: str):
    """Scalar column: distinct ids of an entity over all rows."""
    return count_members(members, [], entity, "n").select(F.coalesce("n", F.lit(0))).scalar()
