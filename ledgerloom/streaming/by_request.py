"""Receipt settlement as a stream keyed below the account.

Two stateful operators in a row, so that no account meets in one task:

1. *first presentation*, keyed by account and receipt key (account number,
   reference, day and amount, normalised): the first eligible receipt of a key
   consumes it, later ones are duplicates, as in the batch form;
2. *request ledger*, keyed by request: receipts, unreadable receipts and manual
   decisions in order of arrival change paid sum and status. A request that is
   covered, sent to review or decided is closed for good.

All gates before (unknown or stored-closed request, unreadable, unsuccessful,
wrong account) are native columns; receipts without a key go to the second
operator directly. Money is whole cents. State starts from the stored
requests: the keys of receipts accepted earlier are consumed, paid sums and
states are carried on.

Events of a key or request are put in order of arrival within a micro-batch;
micro-batches follow each other. A task holds a few numbers for each event of
the key at hand; ``max_files_per_trigger`` bounds a micro-batch. Under the
rule "first presentation consumes the key" the result equals the batch form's
(``operators.settlement``), whatever the cut into micro-batches, as long as
arrivals don't go back over a cut.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ledgerloom.functions.numbers import MONEY_SUM, cents_to_money, safe_money
from ledgerloom.operators.requests import (OPEN_STATUSES, STATUS_APPROVED, STATUS_PARTIAL, STATUS_PENDING,
                                           STATUS_REJECTED, STATUS_REVIEW, folded_status)
from ledgerloom.operators.settlement import REQUEST, receipt_keys, stored_keys, stored_state, with_request_state
from ledgerloom.sources.sinks import scratch_path
from ledgerloom.streaming.settlement import EVENT_SCHEMA, arrival_chunks

KEY = ["casillero", "k_cta", "k_ref", "k_fch", "k_cents"]
GATED = T.StructType([
    T.StructField("casillero", T.StringType()), T.StructField("id", T.StringType()),
    T.StructField("event_id", T.LongType()), T.StructField("arrival", T.LongType()),
    T.StructField("kind", T.StringType()), T.StructField("gate", T.StringType()),
    T.StructField("cents", T.LongType()), T.StructField("requested", T.LongType()),
])
SETTLED = T.StructType([
    T.StructField("casillero", T.StringType()), T.StructField("id", T.StringType()),
    T.StructField("event_id", T.LongType()), T.StructField("arrival", T.LongType()),
    T.StructField("verdict", T.StringType()), T.StructField("status", T.StringType()),
    T.StructField("paid_cents", T.LongType()), T.StructField("first_date", T.LongType()),
])
OUTPUT = T.StructType([*SETTLED.fields[:3], T.StructField("arrival", T.TimestampType()), *SETTLED.fields[4:6],
                       T.StructField("paid", T.DecimalType(38, 2)), T.StructField("first_date", T.TimestampType())])


def cents(money) -> F.Column:
    return (money * 100).cast("bigint")


def gated(events: DataFrame, requests: DataFrame | None = None) -> DataFrame:
    """Events with the first gate that stops them (null: none), the receipt's key and all money in cents."""
    decision = F.col("kind").isin("approve", "reject")
    if requests is not None:
        events = with_request_state(events, requests)
    k = receipt_keys(events)
    unknown = F.col("_known").isNull() if requests is not None else F.lit(False)
    gate = (F.when(decision, None).when(unknown, "unknown_request").when(~F.col("_ok_req"), "closed")
            .when(~F.col("_ok_read"), "unreadable").when(~F.col("_ok_tx"), "unsuccessful").when(~F.col("_ok_cta"), "wrong_account"))
    requested = safe_money("monto_solicitado")
    return k.select("casillero", "id", "event_id", "arrival", F.coalesce("kind", F.lit("receipt")).alias("kind"), gate.alias("gate"),
                    F.coalesce(cents(F.col("k_mto")), F.lit(0)).alias("cents"), F.coalesce(cents(requested), F.lit(0)).alias("requested"),
                    "k_cta", "k_ref", "k_fch", cents(F.col("k_mto")).alias("k_cents"),
                    (~decision & gate.isNull() & (F.col("k_ref") != "") & F.col("k_mto").isNotNull()).alias("_keyed"))


def by_arrival(rows) -> list:
    """The events of a key in order of arrival (those without one last). Rows come one by one: most keys have a few, and a
    frame for each costs more than its events."""
    return sorted(rows, key=lambda r: (r.arrival is None, r.arrival or 0, r.event_id is None, r.event_id or 0))


class FirstPresentation(StatefulProcessor):
    """The first event of a key passes, later ones are duplicates."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.seen.update((True,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        again = known = self.seen.exists()
        row = Row(*GATED.fieldNames())
        for r in by_arrival(rows):
            yield row(r.casillero, r.id, r.event_id, r.arrival, r.kind, "duplicate" if again else r.gate, r.cents, r.requested)
            again = True
        if not known:
            self.seen.update((True,))

    def close(self) -> None:
        pass


def settle(state: tuple, kind: str, gate: str | None, amount: int, requested: int, at) -> tuple[str, tuple]:
    """One event on a request's state (status, paid, first date, requested): the verdict and the state after it."""
    status, paid, first, wanted = state
    if kind in ("approve", "reject"):
        return "decision", (STATUS_APPROVED if kind == "approve" else STATUS_REJECTED, paid, first, wanted)
    wanted = requested if wanted is None else wanted
    is_open = status in OPEN_STATUSES
    if gate == "unreadable":
        if is_open:
            status, first = STATUS_REVIEW, first or at
        return gate, (status, paid, first, wanted)
    if gate is not None:
        return gate, (status, paid, first, wanted)
    if not is_open:
        return "closed", (status, paid, first, wanted)
    paid += amount
    return "applied", (STATUS_APPROVED if 0 < wanted <= paid else STATUS_PARTIAL, paid, first or at, wanted)


class RequestLedger(StatefulProcessor):
    """Paid sum and status of one request."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("request", "status string, paid bigint, first bigint, requested bigint")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.state.update((initialState.status, initialState.paid, None, initialState.requested))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = state = tuple(self.state.get()) if self.state.exists() else (STATUS_PENDING, 0, None, None)
        row = Row(*SETTLED.fieldNames())
        for r in by_arrival(rows):
            if r.gate == "unknown_request":
                yield row(*key, r.event_id, r.arrival, r.gate, None, None, None)
                continue
            verdict, state = settle(state, r.kind, r.gate, r.cents, r.requested, r.arrival)
            yield row(*key, r.event_id, r.arrival, verdict, *state[:3])
        if state != before:
            self.state.update(state)

    def close(self) -> None:
        pass


def request_stream(spark: SparkSession, source: str, requests: DataFrame | None = None,
                   max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming DataFrame of one row per event (``OUTPUT``) from a parquet folder of ``EVENT_SCHEMA``."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    # a micro-batch writes what changed, not each partition's whole state
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    reader = spark.readStream.schema(EVENT_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    # the operators see instants as microseconds
    events = gated(reader.parquet(source), requests).withColumn("arrival", F.unix_micros("arrival"))
    taken = ledger = None
    if requests is not None:
        taken = stored_keys(requests).withColumn("k_cents", cents(F.col("k_mto"))).select(*KEY).groupBy(*KEY)
        ledger = stored_state(requests).select(
            *REQUEST, folded_status("_status0").alias("status"), F.coalesce(cents(F.col("_paid0")), F.lit(0)).alias("paid"),
            F.coalesce(cents(safe_money("monto_solicitado")), F.lit(0)).alias("requested")).groupBy(*REQUEST)
    keyed = (events.filter("_keyed").groupBy(*KEY)
             .transformWithState(FirstPresentation(), GATED, "Append", "None", initialState=taken))
    plain = events.filter("NOT _keyed").select(*GATED.fieldNames())
    settled = (keyed.unionByName(plain).groupBy(*REQUEST)
               .transformWithState(RequestLedger(), SETTLED, "Append", "None", initialState=ledger))
    return settled.withColumns({"paid": cents_to_money(F.col("paid_cents")).cast(MONEY_SUM), "arrival": F.timestamp_micros("arrival"),
                                "first_date": F.timestamp_micros("first_date")}).select(*OUTPUT.fieldNames())


def run_request_stream(spark: SparkSession, events: DataFrame, requests: DataFrame | None = None, chunks: int = 2) -> DataFrame:
    """Feed events in ``chunks`` arrivals, the query restarted from its checkpoint for each; the rows of the sink."""
    from ledgerloom.session import checkpoint_dir
    checkpoint_dir(spark)
    run = scratch_path(spark, "request-stream", uuid.uuid4().hex[:12])
    if requests is not None:
        requests = requests.checkpoint(eager=True)
    tagged = arrival_chunks(events, chunks)
    for c in range(chunks):
        tagged.filter(F.col("_chunk") == c).drop("_chunk").write.mode("append").parquet(f"{run}/input")
        q = (request_stream(spark, f"{run}/input", requests).writeStream.format("parquet").outputMode("append")
             .option("checkpointLocation", f"{run}/checkpoint").trigger(availableNow=True).start(f"{run}/output"))
        q.awaitTermination()
    return spark.read.schema(OUTPUT).parquet(f"{run}/output")
