"""Tables on the shared folder, internal ids, and column bookkeeping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tillroll.session import scratch_path

#: what a null id counts as inside an operator; it sorts before every other id
NULL_ID = -(2**63)

#: whitespace and words of the text contracts, as regular expressions
SPACES = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends here,
    and a lost executor costs only the tasks of the job that is running."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def named(column: str) -> Column:
    return F.col("`" + column.replace("`", "``") + "`")


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """df without the columns of these names (any case): an operator's own
    result columns replace columns of the input that are called the same."""
    drop = {n.lower() for n in names}
    return df.select(*[named(c) for c in df.columns if c.lower() not in drop])


def private(columns: list[str]) -> str:
    """A prefix that no input column has, for an operator's own columns beside them."""
    prefix = "_"
    while any(c.lower().startswith(prefix) for c in columns):
        prefix += "_"
    return prefix


def in_arrow(df: DataFrame, function, schema) -> DataFrame:
    """mapInArrow for functions that take columns by position, so that input
    columns may have any name."""
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))]).mapInArrow(function, schema)


def id_of(column: str) -> Column:
    return F.coalesce(named(column).cast("long"), F.lit(NULL_ID))


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession, rows: int = 4000, size: int = 4 << 20) -> None:
    """Arrow batches of so many rows and bytes at most, so that a Python worker
    holds a few MB of text at once; smaller settings of the session stay."""
    for key, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        key = f"spark.sql.execution.arrow.{key}"
        have = spark.conf.get(key)
        if not have.isdigit() or not 0 < int(have) <= most:
            spark.conf.set(key, str(most))
