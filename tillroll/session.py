"""SparkSession factory and shared-storage helpers."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Defaults applied only when the session does not already define them, so a
# cluster's own settings (spark-defaults.conf, --conf) always win.
_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # the planner (and AQE at run time, from real shuffle sizes) broadcasts a
    # join side only below this size; above it the join stays sort-merge
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


# known only when a session is launched
_LAUNCH = {"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.scheduler.mode": "FAIR"}


def get_session(master: str | None = None, app: str = "tillroll",
                shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    """A session with the package's defaults. A session that already runs is
    returned as it is (with ``extra`` applied); settings given at submit win."""
    running = SparkSession.getActiveSession() is not None
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    if not running:
        for k, v in _LAUNCH.items():
            builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    given = spark.sparkContext.getConf()
    if not running:
        for k, v in _DEFAULTS.items():
            if not given.contains(k):
                spark.conf.set(k, v)
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_root(spark: SparkSession) -> str:
    """Shared folder for lineage cuts and written tables.

    Uses the cluster's ``spark.checkpoint.dir``. A local session (tests, bench)
    that has none gets a private temporary folder; on a cluster that would be
    each machine's own disk, so there the setting is required.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d is None:
        conf = sc.getConf().get("spark.checkpoint.dir", None)
        if not conf:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            conf = tempfile.mkdtemp(prefix="tillroll-ckpt-")
        sc.setCheckpointDir(conf)
        d = sc.getCheckpointDir()
    return d


#: bytes that a task reads at most of files or, compressed, of a shuffle. Rows of baskets
#: and facts grow tenfold in memory; tasks of Spark's default sizes would sort them on disk.
_TASKS = {"spark.sql.files.maxPartitionBytes": 32 << 20, "spark.sql.adaptive.advisoryPartitionSizeInBytes": 16 << 20}


def small_tasks(spark: SparkSession) -> None:
    """Lowers the sizes of tasks to what sorts in memory, where the session allows more.
    Only the number of tasks follows from them, not what they do."""
    for key, most in _TASKS.items():
        if _bytes(spark.conf.get(key, str(most + 1))) > most:
            spark.conf.set(key, str(most))


def _bytes(size: str) -> int:
    """The bytes of a setting such as 8m."""
    number, unit = re.match(r"\s*(-?\d+)\s*([a-z]?)", size.lower()).groups()
    return int(number) << {"k": 10, "m": 20, "g": 30, "t": 40}.get(unit, 0)


#: bytes that a row of few columns takes in a broadcast table
_BROADCAST_ROW = 48


def lookup_table(df: DataFrame, name: str) -> DataFrame:
    """A table that many jobs join with, stored once. The planner knows it by the size of
    its compressed files, some 30 times less than its rows take when broadcast; where these
    exceed the session's bound, the joins shuffle it instead of gathering it at the driver."""
    stored = written(df, name)
    bound = _bytes(df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold", "10m"))
    return stored.hint("merge") if stored.count() * _BROADCAST_ROW > bound else stored


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back (lineage ends here)."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared folder."""
    return f"{shared_root(spark).rstrip('/')}/tillroll/{name}-{uuid.uuid4().hex[:12]}"

