"""Stateful stream = plain state machine; stream = batch without the named case."""

from collections import defaultdict

from pyspark.sql import functions as F

from ledgerloom.operators import settlement
from ledgerloom.sources import adapters as A
from ledgerloom.streaming.settlement import AccountMachine, cents_text, run_settlement_stream, settlement_events
from tests.conftest import SF_MID, SF_SMALL


def machine_run(events_pdf):
    ms = defaultdict(AccountMachine)
    out = {}
    for ev in events_pdf.sort_values(["arrival", "event_id"]).to_dict("records"):
        m = ms[ev["casillero"]]
        v, r = m.step(ev)
        out[int(ev["event_id"])] = (v, r["status"], cents_text(r["paid"]))
    return out


import pytest  # noqa: E402


@pytest.mark.parametrize("engine", ["map_state", "value_state"])
def test_stream_equals_machine_with_decisions(spark, engine):
    ev = settlement_events(A.load(spark, SF_SMALL, "receipts"), with_decisions=True)
    got = {r.event_id: (r.verdict, r.status, r.paid)
           for r in run_settlement_stream(spark, ev, chunks=3, engine=engine).collect()}
    exp = machine_run(ev.toPandas())
    assert got == exp
    assert any(v[0] == "decision" for v in got.values())


def test_every_receipt_stays_a_receipt(spark):
    rc, dc = A.load(spark, SF_SMALL, "receipts"), A.load(spark, SF_SMALL, "decisions")
    ev = settlement_events(rc, decisions=dc)
    assert {r.event_id for r in ev.where("kind = 'receipt'").collect()} == {r.event_id for r in rc.collect()}
    assert ev.where("kind <> 'receipt'").select("event_id").distinct().count() == dc.count()
    import __spark_entry__ as E
    got = {r.event_id: (r.verdict, r.status, r.paid) for r in E.queries()["receipt_settlement_stream"](spark, SF_SMALL).collect()}
    assert got == machine_run(ev.toPandas())
    assert all((v[0] == "decision") == (k < 0) for k, v in got.items())


@pytest.mark.parametrize("engine", ["map_state", "value_state"])
def test_decisions_of_a_request(spark, engine):
    """A decision closes its request; one before any receipt leaves the requested account to the receipt; seq orders a day."""
    rc = spark.createDataFrame(
        [("1", "a", k, f"2024-01-0{k} 00:00:00", "100", "11", "60", cta, f"r{k}") for k, cta in ((1, "11"), (3, "11"))]
        + [("1", "b", k, f"2024-01-0{k} 00:00:00", "100", "11", "60", cta, f"r{k}") for k, cta in ((4, "99"), (5, "11"))],
        "casillero string, id string, event_id int, arrival string, monto_solicitado string, cuenta_solicitada string, monto string, "
        "cuenta string, referencia string").selectExpr("*", "'x' AS fecha", "true AS exitosa", "true AS readable")
    dc = spark.createDataFrame([("1", "a", "aprobada", "2024-01-02", 2), ("1", "a", "rechazada", "2024-01-02", 1), ("1", "b", " Aprobada", None, 1)],
                               "casillero string, id string, estado string, fecha_decision string, seq int")
    got = run_settlement_stream(spark, settlement_events(rc, decisions=dc), chunks=2, engine=engine).collect()
    assert {r.event_id: (r.verdict, r.status, r.paid) for r in got if r.event_id > 0} == {
        1: ("applied", "parcial", "60.00"), 3: ("closed", "aprobada", "60.00"),
        4: ("wrong_account", "aprobada", "0.00"), 5: ("closed", "aprobada", "0.00")}
    assert sorted(r.verdict for r in got if r.event_id < 0) == ["decision"] * 3


def _without_named_case(rc):
    """Drop every presentation of keys first presented to a closed request
    (batch consumes such a key, the machine does not); repeat to a fixpoint."""
    keys = ["casillero", "k_cta", "k_ref", "k_fch", "k_mto"]
    for _ in range(6):
        batch = settlement.receipt_settlement(rc)
        dd = settlement.receipt_dedupe(rc)
        first = dd.filter(~F.col("duplicate") & (F.col("k_ref") != "") & F.col("k_mto").isNotNull())
        bad = (first.join(batch.filter(F.col("verdict") == "closed").select("event_id"), "event_id")
               .select(*keys).distinct())
        if bad.count() == 0:
            return rc
        drop = dd.join(bad, keys).select("event_id")
        rc = rc.join(drop, "event_id", "left_anti").checkpoint(eager=True)
    raise AssertionError("no fixpoint")


def test_stream_equals_batch_without_named_case(spark):
    from ledgerloom.session import checkpoint_dir
    checkpoint_dir(spark)
    rc = _without_named_case(A.load(spark, SF_MID, "receipts"))
    kb = {r.event_id: (r.verdict, r.status) for r in settlement.receipt_settlement(rc).collect()}
    st = run_settlement_stream(spark, settlement_events(rc, with_decisions=False), chunks=3).collect()
    assert len(kb) > 1000
    assert {k: v[0] for k, v in kb.items()} == {r.event_id: r.verdict for r in st}
    final = {}
    for r in sorted(st, key=lambda r: r.event_id):
        final[(r.casillero, r.id)] = r.status
    bstat = {(r.casillero, r.id): r.status for r in settlement.receipt_settlement(rc).collect()}
    assert final == bstat


def test_handler_unpickles_without_the_package(tmp_path):
    """Stream workers may not have the package on their path: the handler's
    code travels with it (pickled by value)."""
    import subprocess
    import sys

    from pyspark import cloudpickle

    import ledgerloom.streaming.settlement as S
    cloudpickle.register_pickle_by_value(S)
    blob = tmp_path / "proc.pkl"
    blob.write_bytes(cloudpickle.dumps((S.SettlementProcessor(), S._handler(None))))
    code = ("import sys; sys.path = [p for p in sys.path if 'repo' not in p]\n"
            "from pyspark import cloudpickle\n"
            f"proc, fn = cloudpickle.loads(open({str(blob)!r}, 'rb').read())\n"
            "import importlib.util; assert importlib.util.find_spec('ledgerloom') is None\n"
            "print(type(proc).__name__, callable(fn))")
    out = subprocess.run([sys.executable, "-c", code], cwd=str(tmp_path), capture_output=True, text=True,
                         env={"PATH": "/usr/bin:/bin"}, timeout=120)
    assert out.returncode == 0, out.stderr[-2000:]
    assert "SettlementProcessor True" in out.stdout


# ------------------------------------------------ keyed by request and receipt

def _with_refunds(rc):
    """Some amounts negative, larger than the receipts around them."""
    return rc.withColumn("monto", F.expr("CASE WHEN event_id % 5 = 0 THEN -3 * monto ELSE monto END"))


@pytest.mark.parametrize("stored", [False, True])
@pytest.mark.parametrize("chunks", [1, 3])
def test_stream_by_request_equals_batch(spark, stored, chunks):
    """Verdict and paid sum of every receipt, with negative amounts and from stored requests, whatever the cut."""
    from ledgerloom.streaming.by_request import run_request_stream
    rc = _with_refunds(A.load(spark, SF_SMALL, "receipts"))
    requests = A.load(spark, SF_SMALL, "open_requests") if stored else None
    got = {r.event_id: r for r in run_request_stream(spark, settlement_events(rc), requests, chunks).collect()}
    want = {r.event_id: r for r in settlement.receipt_settlement(rc, requests).collect()}
    assert {k: r.verdict for k, r in got.items()} == {k: r.verdict for k, r in want.items()}
    assert all(got[k].paid == r.paid_after for k, r in want.items() if r.paid_after is not None)
    last = {}
    for r in sorted(got.values(), key=lambda r: (r.arrival, r.event_id)):
        last[r.casillero, r.id] = (r.status, r.paid)
    ends = {(r.casillero, r.id): (r.status, r.paid) for r in want.values() if r.verdict != "unknown_request"}
    assert {k: v for k, v in last.items() if k in ends} == {k: (s.strip().lower() if s else s, p) for k, (s, p) in ends.items()}


def test_a_close_is_for_good(spark):
    """Batch, stream and machine: a negative receipt after the close does not open the request again."""
    from ledgerloom.streaming.by_request import run_request_stream
    amounts = {1: "60", 2: "50", 3: "-100", 4: "30", 5: "0.005"}
    rc = spark.createDataFrame([("1", "a", k, f"2024-01-0{k} 00:00:00", "100", "", m, "11", f"r{k}") for k, m in amounts.items()],
                               "casillero string, id string, event_id int, arrival string, monto_solicitado string, cuenta_solicitada string, "
                               "monto string, cuenta string, referencia string").selectExpr("*", "'x' AS fecha", "true AS exitosa", "true AS readable")
    ev = settlement_events(rc)
    verdicts = {1: "applied", 2: "applied", 3: "closed", 4: "closed", 5: "closed"}
    assert {r.event_id: r.verdict for r in settlement.receipt_settlement(rc).collect()} == verdicts
    assert {r.event_id: r.verdict for r in run_request_stream(spark, ev, chunks=2).collect()} == verdicts
    assert {k: v[0] for k, v in machine_run(ev.toPandas()).items()} == verdicts


def test_batch_equals_machine_with_negative_amounts(spark):
    rc = _without_named_case(_with_refunds(A.load(spark, SF_SMALL, "receipts")))
    batch = {r.event_id: (r.verdict, r.status) for r in settlement.receipt_settlement(rc).collect()}
    machine = machine_run(settlement_events(rc).toPandas())
    assert {k: v[0] for k, v in batch.items()} == {k: v[0] for k, v in machine.items()}
    assert any(v[0] == "closed" for v in batch.values()) and any(v[0] == "applied" for v in batch.values())


def test_decisions_close_a_request_of_the_stream(spark):
    from ledgerloom.streaming.by_request import run_request_stream
    rc = A.load(spark, SF_SMALL, "receipts")
    ev = settlement_events(rc, with_decisions=True)
    got = sorted(run_request_stream(spark, ev, chunks=2).collect(), key=lambda r: (r.arrival, r.event_id))
    closed = set()
    for r in got:
        if r.verdict == "decision":
            closed.add((r.casillero, r.id))
        assert not (r.verdict == "applied" and (r.casillero, r.id) in closed)
    assert closed and len(got) == ev.count()


def test_a_hot_account_is_spread_over_tasks(spark):
    """Both operators deal events by receipt key and by request, never by account alone."""
    from pyspark.sql import functions as F2

    from ledgerloom.streaming.by_request import KEY, gated
    rc = A.load(spark, SF_SMALL, "receipts").withColumn("casillero", F2.lit("1"))
    keyed = gated(settlement_events(rc)).filter("_keyed")
    for cols in (KEY, ["casillero", "id"]):
        parts = keyed.repartition(8, *cols).select(F2.spark_partition_id().alias("p")).groupBy("p").count().collect()
        assert len(parts) > 4


def test_money_of_the_machine_is_whole_cents():
    from datetime import datetime
    m = AccountMachine()
    for k in range(1, 101):
        _, r = m.step({"id": "a", "event_id": k, "arrival": datetime(2024, 1, 1), "monto_solicitado": "10", "cuenta_solicitada": "", "monto": "0.1",
                       "cuenta": "", "referencia": f"r{k}", "fecha": ""})
    assert r["paid"] == 1000 and r["status"] == "aprobada"
