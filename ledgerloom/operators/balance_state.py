"""Live balance kept up to date load by load.

Beside the ledger stand two small tables that its loads are folded into:

* ``totals``: for each account and load, the last load date and the official
  total at the last date that has one (the lowest of a day). Both are maxima,
  so partials of any number of loads combine by taking the maximum again;
* ``orders``: the distinct order ids of each account, by which a pending
  request or withdrawal is known to be booked.

A load reads its own rows only. A balance reads the partials, one row an
account and load, and the order ids, never the ledger. Loads are numbered
upwards and added exactly once: a load that is run again, whole or after a
crash between the two tables, changes nothing. ``compact`` folds the partials
of all loads into one row an account and drops repeated order ids, account
bucket by account bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.text import utrim
from ledgerloom.operators.balance import combined_balance, partial_totals, pending_movements, totals_of
from ledgerloom.sources.versioned import VersionedTable

WRITER = "loads"
TOTALS = T.StructType([
    T.StructField("casillero", T.StringType()), T.StructField("last_load", T.TimestampNTZType()),
    T.StructField("best", T.StructType([T.StructField("d", T.TimestampNTZType()), T.StructField("neg", T.DecimalType(18, 2))])),
])
ORDERS = T.StructType([T.StructField("casillero", T.StringType()), T.StructField("key", T.StringType())])


class BalanceState:
    """The state under ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.totals = VersionedTable(spark, f"{root.rstrip('/')}/totals", TOTALS)
        self.orders = VersionedTable(spark, f"{root.rstrip('/')}/orders", ORDERS)

    def add_load(self, rows: DataFrame, load: int) -> bool:
        """Fold the ledger rows of load number ``load`` in; False if they were."""
        orders = rows.select("casillero", utrim("orden").alias("key")).filter(F.col("key").isNotNull()).distinct()
        # the totals come last: a load counts as added when both are
        self.orders.append_once(orders, WRITER, load)
        return self.totals.append_once(partial_totals(rows), WRITER, load)

    def balance(self, requests: DataFrame) -> DataFrame:
        """``balance.live_balance`` of the ledger as loaded so far."""
        best = self.totals.read().groupBy("casillero").agg(F.max("last_load").alias("last_load"), F.max("best").alias("best"))
        booked = self.orders.read().select(F.col("casillero").alias("acct"), "key")
        return combined_balance(totals_of(best), pending_movements(None, requests, booked=booked))

    def compact(self, accounts: DataFrame) -> None:
        """Rewrite the buckets of ``accounts`` (casillero) with one partial an account and each order id once."""
        self.totals.merge(accounts, lambda rows, _: rows.groupBy("casillero").agg(F.max("last_load").alias("last_load"), F.max("best").alias("best")))
        self.orders.merge(accounts, lambda rows, _: rows.distinct())
