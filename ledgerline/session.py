"""SparkSession construction and cluster-facing settings."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

# Settings every job here relies on. AQE re-plans joins at runtime (broadcast
# when a side turns out small, splits skewed partitions); UTC keeps timestamps
# comparable with the SQL oracle; the UI is a server and stays off.
DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "ledgerline", extra: dict | None = None) -> SparkSession:
    """Return the active session, or build one with the defaults above.

    On a cluster the session normally exists already (spark-submit); then only
    unset defaults are applied and nothing the cluster configured is changed.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_LOCAL_CHECKPOINT_DIR: str | None = None


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and build-aside tables.

    The cluster names it in ``spark.checkpoint.dir``; that value always wins
    (it is a core setting, read from the session, never overwritten), then a
    folder set with ``setCheckpointDir``. Where neither is set, one scratch
    folder is created per process in local mode, where there is one machine; on
    a cluster that is an error, since executors could not see it.
    """
    global _LOCAL_CHECKPOINT_DIR
    sc = spark.sparkContext
    current = (spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
               or sc.getCheckpointDir())
    if not current:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if _LOCAL_CHECKPOINT_DIR is None:
            _LOCAL_CHECKPOINT_DIR = tempfile.mkdtemp(prefix="ledgerline-ckpt-")
        current = _LOCAL_CHECKPOINT_DIR
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(current)
    return current


def scratch_path(spark: SparkSession, *parts: str) -> str:
    """A path under the shared checkpoint folder (never a machine-local temp)."""
    return os.path.join(checkpoint_dir(spark), *parts)
