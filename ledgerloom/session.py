"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every operator relies on: UTC wall clock for day arithmetic,
# ANSI mode (so try_* functions are used on dirty input), AQE for runtime
# re-planning of joins / skew / partition coalescing.
SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "ledgerloom") -> SparkSession:
    """Build (or reuse) a session with the library defaults.

    ``master`` is only applied when given (tests and bench use local mode;
    on a cluster the launcher decides).
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    b = b.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    for k, v in SESSION_DEFAULTS.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    apply_defaults(spark)
    return spark


def apply_defaults(spark: SparkSession) -> None:
    """Apply the runtime-settable defaults to an existing session."""
    for k, v in SESSION_DEFAULTS.items():
        if spark.conf.isModifiable(k):
            spark.conf.set(k, v)


#: A shuffle starts with a partition for so many bytes of input; adaptive execution joins small ones again.
BYTES_A_PARTITION = 8 << 20
INITIAL_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def grow_shuffles(spark: SparkSession, n_bytes: int) -> None:
    """Shuffles planned from now on start with a partition for each ``BYTES_A_PARTITION`` of the input, so a task's share
    does not grow with it; never fewer than ``shuffle_partitions`` says."""
    n = -(-n_bytes // BYTES_A_PARTITION)
    if n > shuffle_partitions(spark):
        spark.conf.set(INITIAL_PARTITIONS, str(n))


def shuffle_partitions(spark: SparkSession) -> int:
    """Partitions that a shuffle starts with."""
    return int(spark.conf.get(INITIAL_PARTITIONS, None) or spark.conf.get("spark.sql.shuffle.partitions"))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the setting must point at shared storage and is only read
    here; without it nothing is written. In local mode (tests) a scratch
    folder is created when it is unset.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        return d
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        d = tempfile.mkdtemp(prefix="ledgerloom-ckpt-", dir=os.environ.get("LEDGERLOOM_SCRATCH", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", d)
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d
