"""Session construction and the few runtime settings the library relies on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job here assumes.  AQE re-plans joins from runtime sizes
# (so a broadcast happens only when the measured side is below the threshold)
# and splits skewed shuffle partitions.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64MB",
    "spark.sql.autoBroadcastJoinThreshold": "64MB",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.ui.enabled": "false",
}


# Parquet settings for results whose rows are megabytes long.  The writer counts
# a page's bytes after so many rows only (else 100, all held at once); a value
# that comes again is stored once (in a dictionary of at most so many bytes,
# else 1 MB, which one such value exceeds).
LONG_ROWS_CONF = {
    "parquet.page.size.row.check.min": "8",
    "parquet.dictionary.page.size": str(64 << 20),
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "skyledger", extra: dict | None = None) -> SparkSession:
    """Local session for tests and the bench; on a cluster use the cluster's
    own session and call :func:`prepare_session` on it."""
    b = SparkSession.builder.master(master).appName(app_name)
    conf = dict(BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf["spark.driver.memory"] = "8g"
    # Remove checkpoint files of DataFrames that are no longer referenced.
    conf["spark.cleaner.referenceTracking.cleanCheckpoints"] = "true"
    # Local runs on small inputs: let AQE coalesce shuffle partitions down to
    # 256 KB rather than 1 MB so the few MB of a test table still spread over
    # all cores.  Cluster sessions keep their own setting.
    conf["spark.sql.adaptive.coalescePartitions.minPartitionSize"] = "256KB"
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    prepare_session(spark)
    return spark


def prepare_session(spark: SparkSession) -> SparkSession:
    """Apply runtime settings an existing session may lack; never overrides
    what the cluster has set (checkpoint dir included)."""
    for k in ("spark.sql.session.timeZone",):
        spark.conf.set(k, BASE_CONF[k])
    checkpoint_dir(spark)
    # Stateful batch operators need the state-store coordinator, which is
    # started together with the streaming query manager.
    _ = spark.streams
    return spark


def long_rows_session(spark: SparkSession, column: str) -> SparkSession:
    """A session with the settings of ``spark`` and, where those are not set,
    ``LONG_ROWS_CONF``: its DataFrames are written so, those of ``spark`` as
    before.  The long ``column`` gets no least and greatest value, for which each
    row would be compared byte by byte."""
    long_rows = LONG_ROWS_CONF | {f"parquet.column.statistics.enabled#{column}": "false"}
    own = spark.newSession()
    for k, v in (long_rows | spark.conf.getAll).items():
        if k in long_rows or own.conf.isModifiable(k):
            own.conf.set(k, v)
    return own


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``, or the
    one the context was given.

    Only a local session without either gets a scratch folder: on a cluster
    each machine would have its own, so there a missing setting is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    d = named or sc.getCheckpointDir()
    if not d:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="skyledger-ckpt-")
    if not named:
        spark.conf.set("spark.checkpoint.dir", d)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d


_SHARED: list = []


def materialize(df):
    """Share a DataFrame that several branches of one plan read, keyed the
    same way: ``persist(DISK_ONLY)``.  The cached relation keeps the plan's
    hash partitioning, so the branches neither recompute nor re-shuffle it; a
    lost block, or one that the caller's ``clearCache`` dropped, is rebuilt
    from lineage with the same rows.  It stays until :func:`release_shared`."""
    from pyspark import StorageLevel
    out = df.persist(StorageLevel.DISK_ONLY)
    _SHARED.append(out)
    return out


def release_shared() -> None:
    """Drop every shared input; call it once the results are written."""
    while _SHARED:
        _SHARED.pop().unpersist(blocking=False)


def shared_table(df, name: str):
    """Write ``df`` under the shared checkpoint folder and read it back: its
    rows are fixed from there on, whatever is cached or lost."""
    spark = df.sparkSession
    path = os.path.join(checkpoint_dir(spark), "shared", f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stream_checkpoint(spark: SparkSession, name: str) -> str:
    """Checkpoint location for a named streaming query under the shared dir."""
    return os.path.join(checkpoint_dir(spark), "streams", name)
