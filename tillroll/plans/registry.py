"""Registry of named checks: a Spark query plus, where SQL can express it, the
equivalent DuckDB SQL over the same Parquet tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def comparable(df: DataFrame) -> DataFrame:
    """Round doubles to 6 decimals and render arrays as '|'-joined sorted text,
    the conventions the oracle SQL follows too."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), 6)
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(F.array_sort(F.transform(c, lambda x: x.cast("string"))), "|")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def load_all():
    """Import every module that registers checks."""
    from tillroll.plans import dashboard, maintenance, mining, segmentation  # noqa: F401
    return QUERIES, ORACLES
