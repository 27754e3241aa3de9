"""Balance state, co-located orders, register statistics, file sets, previews and the duplicate scope."""

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.operators import balance, billing, clients, settlement
from ledgerloom.operators.balance_state import BalanceState
from ledgerloom.sources import adapters as A
from ledgerloom.sources import colocated, readers, sinks
from tests.conftest import SF_SMALL


def _root(spark):
    return sinks.scratch_path(spark, "test", uuid.uuid4().hex)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def same(a, b):
    cols = sorted(a.columns)
    return sorted(map(str, a.select(cols).collect())) == sorted(map(str, b.select(cols).collect()))


def test_balance_after_each_load(spark):
    ledger, requests = A.load(spark, SF_SMALL, "ledger"), A.load(spark, SF_SMALL, "requests")
    state, seen = BalanceState(spark, _root(spark)), None
    year = F.year("fecha_carga")
    for n, rows in enumerate([F.coalesce(year >= 1997, F.lit(True)), year < 1994, (year >= 1994) & (year < 1997)]):
        part = ledger.filter(rows)
        assert state.add_load(part, n) and not state.add_load(part, n)
        seen = part if seen is None else seen.unionByName(part)
        assert same(state.balance(requests), balance.live_balance(seen, requests))
    before = state.totals.read().count()
    state.compact(ledger.select("casillero").distinct())
    assert state.totals.read().count() == ledger.select("casillero").distinct().count() < before
    assert same(state.balance(requests), balance.live_balance(ledger, requests))
    assert not state.add_load(ledger, 2)


def test_a_load_that_broke_off_is_finished(spark):
    ledger, requests = A.load(spark, SF_SMALL, "ledger"), A.load(spark, SF_SMALL, "requests")
    state = BalanceState(spark, _root(spark))
    totals = state.totals.append_once
    state.totals.append_once = lambda *a: (_ for _ in ()).throw(RuntimeError("executor lost"))
    try:
        state.add_load(ledger, 0)
    except RuntimeError:
        pass
    state.totals.append_once = totals
    assert state.add_load(ledger, 0)
    assert same(state.balance(requests), balance.live_balance(ledger, requests))


def test_the_ledger_side_is_not_shuffled(spark):
    """Bucketed orders: no exchange above their scan; the requests, of one and of the other kind, come to them."""
    ledger, requests = A.load(spark, SF_SMALL, "ledger"), A.load(spark, SF_SMALL, "requests")
    path, name = _root(spark), f"booked_{uuid.uuid4().hex[:8]}"
    booked = colocated.write_booked_orders(ledger, name, path, buckets=4)
    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        pend = balance.pending_movements(None, requests, booked)
        plan = plan_of(pend)
        lines = plan.splitlines()
        depth = lambda line: len(line) - len(line.lstrip(" :+-"))
        scans = [i for i, line in enumerate(lines) if f"spark_catalog.default.{name}" in line]
        assert scans and all("Bucketed: true" in lines[i] for i in scans)
        for at in scans:
            # from the scan up to the join it feeds
            low = depth(lines[at])
            for line in reversed(lines[:at]):
                if depth(line) < low:
                    low = depth(line)
                    assert "Exchange" not in line
                    if "Join" in line:
                        break
        assert plan.count("Exchange hashpartitioning(acct") == 2
        assert same(pend, balance.pending_movements(ledger, requests))
        again = colocated.open_colocated(spark, f"{name}_again", path, "acct string, key string", colocated.ORDER_KEYS, 4)
        assert same(balance.pending_movements(None, requests, again), pend)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        spark.sql(f"DROP TABLE IF EXISTS {name}_again")
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_a_hot_account_fills_all_buckets(spark):
    ledger = spark.range(4000).select(F.lit("1").alias("casillero"), F.concat(F.lit("o"), F.col("id").cast("string")).alias("orden"))
    name = f"booked_{uuid.uuid4().hex[:8]}"
    booked = colocated.write_booked_orders(ledger, name, _root(spark), buckets=8)
    sizes = [r["count"] for r in booked.groupBy(F.col("_metadata.file_path")).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 1.3 * 4000 / 8
    spark.sql(f"DROP TABLE {name}")


def test_register_maximum_from_statistics(spark):
    register = spark.createDataFrame([("17", "5"), (None, "99"), (" ", "FV-x"), ("x", "1000"), (None, None)], "consecutive string, number string")
    path = _root(spark)
    billing.register_numbers(register).repartition(3).write.parquet(path)
    before = spark.conf.get("spark.sql.sources.useV1SourceList")
    assert billing.stored_register_max(spark, path).first().last_number == billing.register_max(register).first().last_number == 99
    assert spark.conf.get("spark.sql.sources.useV1SourceList") == before
    empty = _root(spark)
    billing.register_numbers(register.where("false")).write.parquet(empty)
    assert billing.stored_register_max(spark, empty).first().last_number is None


def test_files_that_lose_are_not_opened(spark):
    rows = lambda v: spark.createDataFrame([("1", v)], "casillero string, v string")
    loaded, edited = _root(spark), _root(spark)
    for name in ("a.parquet", "b.parquet"):
        rows(f"loaded {name}").write.parquet(f"{loaded}/{name}")
    rows("edited").write.parquet(f"{edited}/b.parquet")
    rows("new").write.parquet(f"{edited}/c.parquet")
    # the loser is no Parquet file at all
    broken = [r.path for r in readers.file_set(spark, loaded).where("file = 'b.parquet'").collect()]
    assert broken
    for path in broken:
        with open(path.removeprefix("file:"), "wb") as f:
            f.write(b"not a parquet file")
    schema = T.StructType.fromDDL("casillero string, v string")
    got = sorted((r.source_file, r.v) for r in readers.read_file_sets(spark, schema, loaded, edited).collect())
    assert got == [("a.parquet", "loaded a.parquet"), ("b.parquet", "edited"), ("c.parquet", "new")]


def test_preview_is_a_group_limit_below_the_shuffle(spark):
    pend = billing.pending(A.load(spark, SF_SMALL, "movements"))
    got = billing.preview(pend, 3)
    assert "WindowGroupLimit" in plan_of(got) and "Partial" in plan_of(got)
    want = []
    rows = sorted(pend.select("casillero", "source_file", "id_ingreso").collect())
    for a in {r.casillero for r in rows}:
        want += [tuple(r) for r in rows if r.casillero == a][:3]
    assert sorted((r.casillero, r.source_file, r.id_ingreso) for r in got.collect()) == sorted(want)


def test_duplicates_over_all_accounts(spark):
    rows = [("1", "a", 1), ("1", "a", 2), ("2", "b", 3), ("2", "b", 4)]
    rc = spark.createDataFrame([(a, i, k, f"2024-01-0{k} 00:00:00", "R1" if k < 4 else "R2") for a, i, k in rows],
                               "casillero string, id string, event_id int, arrival string, referencia string").selectExpr(
        "*", "'100' AS monto_solicitado", "'' AS cuenta_solicitada", "'10' AS monto", "'1' AS cuenta", "'x' AS fecha", "true AS exitosa", "true AS readable")
    flags = lambda scope: {r.event_id: r.duplicate for r in settlement.receipt_dedupe(rc, scope).collect()}
    assert flags("account") == {1: False, 2: True, 3: False, 4: False}
    assert flags("all") == {1: False, 2: True, 3: True, 4: False}


def test_customer_states_equal_the_wide_way(spark):
    cl = A.load(spark, SF_SMALL, "clients")
    cl = cl.unionByName(cl.where("ordinal <= 20").withColumns({"ordinal": F.col("ordinal") + 1_000_000, "correo": F.lit("")}))
    known = A.load(spark, SF_SMALL, "known_customers")
    wide = billing.client_index(cl).join(known.select(F.col("identificacion").alias("client_id")).distinct(), "client_id", "left_anti")
    wide = billing.with_customer_fields(wide)
    want = {r.client_id: r.reason for r in wide.select("client_id", billing.customer_reason(billing.customer_fields()).alias("reason")).collect()}
    got = {r.client_id: r.creason for r in billing.customer_states(cl, known).collect()}
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v} and set(want) <= set(got)


def test_assignment_computes_its_changes_once(spark):
    args = [A.load(spark, SF_SMALL, t) for t in ("movements", "assignment_edits", "clients")]
    plan = plan_of(clients.assignment_apply(*args))
    assert plan.count("Scan ExistingRDD") == 2 and "Aggregate" in plan
