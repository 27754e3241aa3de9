"""Growth: state is asked once a key, tasks grow in number, nothing is parsed twice."""

import uuid

from pyspark.sql import functions as F

from ledgerloom import session
from ledgerloom.operators import clients, sequence
from ledgerloom.sources import adapters as A
from ledgerloom.sources import readers, sheets, sinks
from ledgerloom.streaming.settlement import AccountMachine, _MapStore
from tests.conftest import SF_SMALL


class CountedState:
    """A map state that counts its round trips."""

    def __init__(self):
        self.data, self.calls = {}, 0

    def _called(self, out):
        self.calls += 1
        return out

    def exists(self):
        return self._called(bool(self.data))

    def containsKey(self, k):
        return self._called(k in self.data)

    def getValue(self, k):
        return self._called(self.data[k])

    def updateValue(self, k, v):
        self._called(self.data.update({k: v}))


def test_an_account_asks_its_state_once_a_key():
    import pandas as pd
    states = CountedState(), CountedState()
    stores = [_MapStore(s, lambda v: v, lambda v: v) for s in states]
    plain = AccountMachine()
    events = [{"id": f"r{k % 2}", "arrival": pd.Timestamp(2024, 1, 1) + pd.Timedelta(k, "s"), "monto_solicitado": "1000", "cuenta_solicitada": "1",
               "monto": "1", "cuenta": "1", "referencia": f"ref{k % 3}", "fecha": "x"} for k in range(200)]
    for part in (events[:100], events[100:]):
        before = sum(s.calls for s in states)
        for s in stores:
            s.start()
        m = AccountMachine(keys=stores[0], reqs=stores[1])
        assert [(v, dict(r)) for v, r in map(m.step, part)] == [(v, dict(r)) for v, r in map(plain.step, part)]
        for s in stores:
            s.flush()
        assert sum(s.calls for s in states) - before <= 2 + 3 * 5  # five keys in the maps, whatever the number of events
    assert {k[0]: v for k, v in states[0].data.items()} == plain.keys.data
    assert {k[0]: v for k, v in states[1].data.items()} == plain.reqs.data


def test_shuffles_grow_with_the_input(spark, monkeypatch):
    """A task's share of a table is bounded: more bytes, more partitions; small neighbours are joined again."""
    try:
        A.load(spark, SF_SMALL, "movements")
        assert session.shuffle_partitions(spark) == 8
        monkeypatch.setattr(session, "BYTES_A_PARTITION", 1 << 10)
        A.load(spark, SF_SMALL, "movements")
        assert session.shuffle_partitions(spark) > 100
        df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("n"))
        got = sequence.ranked_within(df, [], ["n"], rank_col="k")
        assert {(r.n, r.k) for r in got.collect()} == {(k, k + 1) for k in range(1000)}
    finally:
        spark.conf.unset(session.INITIAL_PARTITIONS)


def test_movement_files_are_not_dealt_out_by_name(spark):
    root = sinks.scratch_path(spark, "test", uuid.uuid4().hex)
    spark.createDataFrame([("1", "a", "ingresos_1.parquet"), ("1", "b", "ingresos_9.parquet")], "casillero string, ID_INGRESO string, source_file string"
                          ).write.partitionBy("source_file").parquet(root)
    out = readers.load_movement_files(spark, root, accounts=spark.createDataFrame([("1",)], "code string").repartition(2))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()
        assert [r.id_ingreso for r in out.collect()] == ["a"]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_emptied_ids_need_no_client(spark):
    mv = spark.createDataFrame([("1", "f", "x", "7"), ("1", "g", "y", "7"), (None, "g", "z", "7")],
                               "casillero string, source_file string, id_ingreso string, id_cliente string")
    ed = spark.createDataFrame([("1", "f", "x", ""), ("1", "g", "y", "5"), (None, "g", "z", "5")],
                               "casillero string, source_file string, id_ingreso string, nuevo_id_cliente string")
    out = clients.assignment_apply(mv, ed, spark.createDataFrame([("7",)], "identificacion string"))
    assert {(r.id_ingreso, r.id_cliente, r.applied) for r in out.collect()} == {("x", "", True), ("y", "7", False), ("z", "5", True)}
    joins = [line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join LeftOuter, (_new" in line]
    assert not joins


def test_workbooks_are_parsed_once(spark):
    root = sinks.scratch_path(spark, "test", uuid.uuid4().hex)
    sheets.write_sheets(spark.createDataFrame([("a", "x & <y>"), ("a", None)], "file string, t string").coalesce(1), root, "file")
    rows, rejects = sheets.read_sheets(spark, root, {"t": "t"})
    for df in (rows, rejects):
        plan = df._jdf.queryExecution().withCachedData().toString()
        assert "InMemoryRelation" in plan
    assert [r.t for r in rows.orderBy("row").collect()] == ["x & <y>", None] and rejects.count() == 0
    sequence.release()
