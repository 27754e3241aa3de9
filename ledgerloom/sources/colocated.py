"""Bucketed and sorted tables: a join on their keys does not shuffle the large side.

The other side is dealt to the table's buckets. Spark still sorts a bucket
before a merge join, as it does not rely on the order within files; rows that
come sorted sort fast and without spilling runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.text import utrim

#: The join keys of a ledger row that books an order.
ORDER_KEYS = ["acct", "key"]


def write_colocated(df: DataFrame, name: str, path: str, keys: list[str], buckets: int) -> DataFrame:
    """Write ``df`` as the external table ``name`` at ``path``, bucketed and sorted by ``keys``.

    Rows are dealt to tasks by the same hash as to buckets, so each bucket is
    one file.
    """
    (df.repartition(buckets, *keys).write.format("parquet").mode("overwrite").option("path", path)
     .bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name))
    return df.sparkSession.table(name)


def booked_orders(ledger: DataFrame) -> DataFrame:
    """(acct, key): the distinct orders that the ledger books. By account and order, so a hot account fills all buckets."""
    return (ledger.select(F.col("casillero").alias("acct"), utrim("orden").alias("key"))
            .filter(F.col("acct").isNotNull() & F.col("key").isNotNull()).distinct())


def write_booked_orders(ledger: DataFrame, name: str, path: str, buckets: int = 64) -> DataFrame:
    return write_colocated(booked_orders(ledger), name, path, ORDER_KEYS, buckets)


def open_colocated(spark: SparkSession, name: str, path: str, schema: str, keys: list[str], buckets: int) -> DataFrame:
    """The table in a session that does not know it yet."""
    by = ", ".join(keys)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS "
              f"LOCATION '{path}'")
    return spark.table(name)
