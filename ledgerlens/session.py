"""Spark session settings and lineage cuts.

On a cluster the session comes from the launcher; ``configure`` only sets
what the analytics rely on (AQE with skew-join splitting, ANSI casts) and
leaves everything else -- time zone, Arrow conversion for ``toPandas`` -- as
the caller has it.
``materialize`` writes to the shared folder named by ``spark.checkpoint.dir``
and never to a machine-local folder; a private folder is only chosen when the
setting is absent and the master is local, as in tests.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job of the library assumes.  Skew joins: with Spark's default
# thresholds a join partition is split when it is 5x the median and above
# 256 MB, so one vendor / customer holding a third of all rows is processed by
# many tasks instead of one.  Size thresholds are left to the cluster's tuning.
SESSION_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot key also where a later join on the same keys then needs a shuffle of its own.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.ansi.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    for k, v in SESSION_CONF.items():
        spark.conf.set(k, v)
    ensure_checkpoint_dir(spark)
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "ledgerlens") -> SparkSession:
    """A local session for tests and benchmarks (UI off, no extra ports)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("LEDGERLENS_DRIVER_MEMORY", "8g"))
        .config("spark.sql.session.timeZone", "UTC")
    )
    for k, v in SESSION_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for intermediates: ``spark.checkpoint.dir``.

    Where the setting is absent, a private folder is chosen only if driver and
    executors are one process (a ``local`` master, as in tests); any other
    master raises, because executors could not see a folder of the driver.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: no SparkContext, only the setting
        sc = None
    if sc is not None and sc.getCheckpointDir():
        return sc.getCheckpointDir()
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        master = sc.master if sc is not None else "(remote)"
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder shared by the cluster (master {master})")
        conf_dir = tempfile.mkdtemp(prefix="ledgerlens-ckpt-")
    if sc is None:
        return conf_dir
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir()


# Folders written by materialize() and not yet released, per application.
_written: dict[str, list[str]] = {}


def materialize(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` once as Parquet under the checkpoint folder and read it back.

    Like a reliable checkpoint (the result survives executor loss and the
    lineage is cut), but computed in a single job: an eager ``checkpoint()``
    of an unpersisted plan computes it twice, once to count and once to save.
    The folder stays until ``release`` is called or the driver process ends,
    since plans built on it may run any time before that.
    """
    spark = df.sparkSession
    path = intermediate_path(spark, label)
    df.write.mode("error").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def intermediate_path(spark: SparkSession, label: str) -> str:
    """A new folder name under the checkpoint folder, which ``release`` deletes."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/ledgerlens/{label}-{uuid.uuid4().hex}"
    _written.setdefault(_app_id(spark), []).append(path)
    return path


def release(spark: SparkSession) -> int:
    """Delete the intermediates written so far by this application.

    Call it once the results built on them are written; returns the number of
    folders removed.  Goes through Hadoop's file system layer, so any store
    Spark can write to works.
    """
    paths = _written.pop(_app_id(spark), [])
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
    return len(paths)


def _app_id(spark: SparkSession) -> str:
    try:
        return spark.sparkContext.applicationId
    except Exception:  # Spark Connect
        return "remote"
