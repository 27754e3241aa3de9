"""Helpers shared by the operators of this package."""

from __future__ import annotations

import sys
import types
import uuid

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

from ledgerloom.session import checkpoint_dir


def ship(module_name: str) -> None:
    """Pickle the functions of a module by value, so workers need not import the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


ship(__name__)


def worker_state(name: str) -> dict:
    """A dict that lives as long as the Python worker.

    Functions travel by value, so their globals are new in every task; what
    is dear to build (a tokenizer, its caches) is kept here between tasks.
    """
    box = sys.modules.setdefault("_ledgerloom_worker_state", types.ModuleType("_ledgerloom_worker_state"))
    return box.__dict__.setdefault(name, {})


def slices(batches, rows: int):
    """Arrow batches cut to at most ``rows`` rows; memory that Arrow freed goes back to the system after each batch."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
        pa.default_memory_pool().release_unused()


def small_batches(spark: SparkSession) -> None:
    """Fewer rows in an Arrow batch, unless the session has its own setting: texts can be very long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, "1000")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Select columns by exact name and position.

    Other columns, also those whose names differ in letter case only, are
    dropped before an operator adds its own; a missing column is an error.
    """
    cols = df.columns
    plain = df.toDF(*[f"_{i}" for i in range(len(cols))])
    return plain.select(*[plain[f"_{cols.index(n)}"].alias(n) for n in names])


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: lineage ends here."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def at_most(df: DataFrame, limit: int) -> list | None:
    """The rows, or None if there are more than ``limit`` (the size check of a broadcast)."""
    rows = df.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
