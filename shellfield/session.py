"""Session settings and shared scratch space."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Runtime SQL settings the operators are designed for.
#  - Broadcasts are chosen from measured shuffle sizes only; the static estimate
#    of an exploded side can be far too low. Fixed tables carry an explicit hint.
#  - Distance joins group on a superset of their join keys, so the aggregation
#    needs no shuffle. Forcing the skew rule lets AQE split a hot cell anyway and
#    pay for that one extra shuffle only when skew is really there.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "16MB",
    "spark.sql.session.timeZone": "UTC",
}


def tune(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def shuffle_partitions(input_bytes: int, target_bytes: int = 128 << 20, floor: int = 8) -> int:
    """Shuffle partitions so that one reduce task gets about ``target_bytes``."""
    return max(floor, -(-input_bytes // target_bytes))


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for staged tables and checkpoints.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset
    (local tests) a new folder is made.
    """
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(configured)
        return configured
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    sc.setCheckpointDir(made)
    return sc._jsc.sc().getCheckpointDir().get()


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    staged = df.sparkSession.read.schema(df.schema).parquet(path)
    staged.staged_path = path
    return staged


def release(*tables: DataFrame) -> None:
    """Delete staged tables that no later plan reads; other tables are left alone."""
    for df in tables:
        path = getattr(df, "staged_path", None)
        if path:
            target = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def dealt(df: DataFrame, rows_a_task: int) -> DataFrame:
    """``df`` in even parts of about ``rows_a_task`` rows, and at least two for each core.

    A file is read by no more tasks than it has row groups, which may be one; this goes before
    work that is much larger than its input. Parts of less than 1,000 rows are not made.
    """
    rows = df.count()
    parts = max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-rows // rows_a_task))
    return df.repartition(max(1, min(parts, -(-rows // 1000))))


# A table is broadcast up to this many rows, beyond that it is joined by shuffle.
SMALL_ROWS = 100_000


def small_table(df: DataFrame, limit: int = SMALL_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if a count shows that it has at most ``limit`` rows."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def fetched(df: DataFrame, limit: int = SMALL_ROWS) -> DataFrame:
    """Like ``small_table``, but a small result is kept as a local table and not computed again."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))
