"""Golden tests of the operators on small literal frames (FIXTURES cases)."""

import datetime as dt
from decimal import Decimal as D

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerloom import schemas
from ledgerloom.operators import balance, billing, clients, reports, requests, sequence, settlement
from ledgerloom.sources import readers

T = dt.datetime


def ledger_df(spark, rows):
    return spark.createDataFrame(rows, schemas.LEDGER)


def req_df(spark, rows):
    return readers.conform(spark.createDataFrame(rows, "casillero string, id string, monto decimal(18,2), "
                                                       "estado string, mayorista_retira string, id_retiro string, "
                                                       "egreso_retiro decimal(18,2)"), schemas.REQUESTS)


def test_live_balance_cases(spark):
    led = ledger_df(spark, [
        # A: two totals on the last day -> lowest; request id with spaces is booked
        ("A", "Total", T(2024, 1, 2), T(2024, 1, 2), D("100.00"), None, None, None, None),
        ("A", " total ", T(2024, 1, 2), T(2024, 1, 2), D("90.00"), None, None, None, None),
        ("A", "Ingreso", T(2024, 1, 1), T(2024, 1, 1), D("5.00"), None, "C1", None, None),
        # B: no total at the last load date -> last total, stale
        ("B", "Total", T(2024, 1, 1), T(2024, 1, 1), D("-50.00"), None, None, None, None),
        ("B", "Egreso", T(2024, 1, 3), T(2024, 1, 3), D("7.00"), None, None, None, None),
        # C: no totals at all
        ("C", "Ingreso", T(2024, 1, 1), T(2024, 1, 1), D("1.00"), None, None, None, None),
    ])
    req = req_df(spark, [
        ("A", " C1 ", D("10.00"), "aprobada", None, None, None),       # booked -> not pending
        ("A", "C2", D("20.00"), " Aprobada ", None, None, None),       # pending in
        ("A", "C3", None, "aprobada", None, None, None),               # null amount -> 0, counted
        ("B", "C4", D("5.00"), "pendiente", None, None, None),         # not approved
        ("D", "C5", D("30.00"), "aprobada", "B", "retiro1", D("31.50")),  # withdrawal by B
    ])
    got = {r.casillero: r for r in balance.live_balance(led, req).collect()}
    assert got["A"].base_total == D("90.00") and got["A"].pending_in == D("20.00")
    assert got["A"].bad_amounts == 1 and got["A"].live_balance == D("110.00") and not got["A"].stale_total
    assert got["B"].base_total == D("-50.00") and got["B"].stale_total
    assert got["B"].pending_out == D("31.50") and got["B"].live_balance == D("-81.50") and got["B"].sign == "red"
    assert got["C"].base_total == D("0.00") and got["C"].live_balance == D("0.00")
    assert got["D"].pending_in == D("30.00") and got["D"].live_balance == D("30.00")


def test_income_reason_classes(spark):
    rows = [("A", "Ingreso", T(2024, 1, i), T(2024, 1, i), D("10.00"), m, f"O{i}", p, None)
            for i, (m, p) in enumerate([(" ingreso  extra ", "x"), ("Ingresos-Extra", "x"), ("devolución", "x"),
                                        ("DEVOLUCION", "x"), (None, "x"), ("Pago", " total "),
                                        ("ingreso extra", "PARCIAL")], start=1)]
    rows.append(("A", "Ingreso", T(2024, 1, 9), T(2024, 1, 9), D("0.00"), "x", "O9", "x", None))
    rows.append(("A", "Ingreso", T(2024, 1, 9), None, D("3.00"), "x", "O10", "x", None))
    out = {r.orden if r.orden else r.fecha.day: r.motivo
           for r in reports.income_report(ledger_df(spark, rows)).collect()}
    assert out == {1: "Ingreso_extra", 2: "Ingreso_extra", "O3": "Devolucion", "O4": "Devolucion",
                   5: "Consignacion cuenta propia", "O6": "Devolucion", "O7": "Devolucion"}


def test_balance_series_seven_days(spark):
    rows = [("A", "Total", T(2024, 1, d, 10), T(2024, 1, d, h), D(str(d)), None, None, None, None)
            for d in range(1, 11) for h in (1, 2)]
    out = reports.balance_series(ledger_df(spark, rows)).collect()
    assert sorted({r.fecha_carga.day for r in out}) == list(range(4, 11)) and len(out) == 14


def test_weekly_window_ends_at_data_max(spark):
    rows = [("A", "Egreso", T(2024, 1, d), T(2024, 1, d), D("1.00"), None, None, None, None) for d in (1, 3, 9, 10)]
    rows.append(("A", "Egreso", T(2024, 1, 10), T(2024, 1, 10), None, None, None, None, None))
    got = {r.fecha.day: (r.n_purchases, r.sum_purchases)
           for r in reports.weekly_purchases(ledger_df(spark, rows)).collect()}
    assert got == {9: (1, D("1.00")), 10: (2, D("1.00"))}  # day 3 is before max - 6 days


def test_receipts_json(spark):
    df = spark.createDataFrame([
        ("A", "C1", "parcial", D("100.00"), '[{"monto": 30.5, "cuenta": "1"}, {"monto": "20", "cuenta": "1"}]'),
        ("A", "C2", "en revision", D("10.00"), '{"monto": 10}'),
        ("A", "C3", "parcial", D("10.00"), "no json"),
        ("A", "C4", "parcial", D("10.00"), None),
        ("A", "C5", "parcial", D("10.00"), '[{"monto": "abc"}]'),
    ], "casillero string, id string, estado string, monto decimal(18,2), comprobantes string")
    bal = {r.id: (r.paid, r.missing, r.n_receipts) for r in requests.request_balance(df).collect()}
    assert bal["C1"] == (D("50.50"), D("49.50"), 2)
    assert bal["C2"] == (D("0.00"), D("10.00"), 0) and bal["C3"][2] == 0 and bal["C4"][2] == 0
    assert bal["C5"] == (D("0.00"), D("10.00"), 1)
    ex = requests.receipts_explode(df).collect()
    assert sorted((r.id, r.n, r.monto) for r in ex) == [("C1", 1, D("30.50")), ("C1", 2, D("20.00")),
                                                          ("C5", 1, None)]


def test_append_receipt_reencodes(spark):
    df = spark.createDataFrame([("A", "C1", '[{"monto": "5"}]')], "casillero string, id string, comprobantes string")
    new = spark.createDataFrame([("A", "C1", "r", "b", "7.5", "f", "1", "x", T(2024, 1, 1))],
                                "casillero string, id string, ruta string, banco string, monto string, "
                                "fecha string, cuenta string, referencia string, arrival timestamp")
    r = requests.append_receipt(df, new).collect()[0]
    assert r.monto_abonado == D("12.50") and r.comprobantes.count("monto") == 2


def test_next_ids(spark):
    df = req_df(spark, [("A", "Consignacion9", D("1"), "x", None, None, None),
                        ("A", "Consignacion10 ", D("1"), "x", "B", "retiro4", None),
                        ("C", "abc", D("1"), "x", "B", "retiro2", None)])
    got = {r.casillero: (r.next_request_id, r.next_withdrawal_id) for r in requests.next_ids(df).collect()}
    assert got == {"A": ("Consignacion11", "retiro1"), "B": ("Consignacion1", "retiro5"),
                   "C": ("Consignacion1", "retiro1")}


def test_upsert_last_wins_and_unmatched(spark):
    df = req_df(spark, [("A", "C1", D("1"), "pendiente", None, None, None), ("A", "C2", D("1"), "parcial", None, None,
                                                                               None)])
    upd = spark.createDataFrame([("A", "C1", "aprobada", 1), ("A", "C1", "rechazada", 2), ("A", "X", "aprobada", 1)],
                                "casillero string, id string, estado string, seq int")
    got = {r.id: r.estado for r in requests.upsert_by_id(df, upd).collect()}
    assert got == {"C1": "rechazada", "C2": "parcial"}
    assert [r.id for r in requests.unmatched_updates(df, upd).collect()] == ["X"]


def test_clients_clean_codes(spark):
    df = spark.createDataFrame([("1", "5", "5001.0", "300.0"), ("2", "0", "00000", None), (None, "05", "", "1")],
                               "identificacion string, codigo_departamento string, codigo_ciudad string, telefono string")
    got = {r.identificacion: (r.codigo_departamento, r.codigo_ciudad, r.telefono, r.tipo_identificacion)
           for r in clients.clients_clean(df).collect()}
    assert got["1"] == ("05", "05001", "300", "13")
    assert got["2"] == ("", "", None, "13")
    assert got[None] == ("05", "", "1", None)


def test_client_lookup_raw_or_normalised(spark):
    cl = clients.clients_clean(spark.createDataFrame([("1.234.567",), ("89",)], "identificacion string"))
    probes = spark.createDataFrame([("1234567",), ("1.234.567",), ("8-9",), ("",)], "probe string")
    got = sorted((r.probe, r.identificacion) for r in clients.client_lookup(cl, probes).collect())
    assert got == [("1.234.567", "1.234.567"), ("1234567", "1.234.567"), ("8-9", "89")]


def test_customer_name_split(spark):
    df = spark.createDataFrame([("1", "Ana Maria Paz", None), ("2", "Luis", " nan "), ("3", "A B", "C")],
                               "identificacion string, nombres string, apellidos string")
    df = billing.with_customer_fields(df)
    f = billing.customer_fields()
    got = {r.i: (r.n, r.a) for r in df.select(f["identification"].alias("i"), f["first_name"].alias("n"),
                                                f["last_name"].alias("a")).collect()}
    assert got == {"1": ("Ana Maria", "Paz"), "2": ("Luis", "Luis"), "3": ("A B", "C")}


def test_client_index_last_row_wins(spark):
    df = spark.createDataFrame([("7", "old", 1), ("7.0", "new", 2), ("8", "x", 3)],
                               "identificacion string, nombres string, ordinal long")
    got = {r.client_id: r.nombres for r in billing.client_index(df).collect()}
    assert got == {"7": "new", "8": "x"}


def test_numbering_skips_reserved_and_stops_at_limit(spark):
    valid = spark.createDataFrame([("A", "f", f"id{i:02d}") for i in range(6)],
                                  "casillero string, source_file string, id_ingreso string")
    reg = spark.createDataFrame([("10", None), (None, "FV-x"), ("", "12")], "consecutive string, number string")
    reserved = spark.createDataFrame([(14,), (15,)], "number long")
    nums, over = billing.assign_numbers(valid, reg, reserved, limit=18)
    got = sorted((r.id_ingreso, r.number) for r in nums.collect())
    assert got == [("id00", 13), ("id01", 16), ("id02", 17), ("id03", 18)]
    assert sorted(r.id_ingreso for r in over.collect()) == ["id04", "id05"]


def test_ranked_within_hot_group_matches_row_number(spark):
    df = spark.range(0, 5000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 50).cast("string")).alias("g"),
        (F.col("id") * 7919 % 5003).alias("o"), F.lit(1).cast("long").alias("v"))
    got = sequence.ranked_within(df, ["g"], ["o"], value_col="v", num_partitions=16)
    w = Window.partitionBy("g").orderBy("o")
    exp = df.withColumn("seq", F.row_number().over(w)).withColumn("running", F.sum("v").over(w))
    diff = got.select("g", "o", "seq", "running").exceptAll(exp.select("g", "o", "seq", "running"))
    assert diff.count() == 0 and got.count() == 5000


def test_writeback_every_source(spark):
    mv = spark.createDataFrame([("A", "a", "X1", None), ("A", "b", "X1 ", ""), ("A", "a", "X2", "9")],
                               "casillero string, source_file string, id_ingreso string, factura string")
    inv = spark.createDataFrame([("A", "a", "X1", 101)], "casillero string, source_file string, id_ingreso string, "
                                                           "number long")
    got = sorted((r.source_file, r.id_ingreso, r.factura) for r in billing.writeback(mv, inv).collect())
    assert got == [("a", "X1", "101"), ("a", "X2", "9"), ("b", "X1 ", "101")]


def test_reply_triage(spark):
    df = spark.createDataFrame([("invalid_total_payments ... calculated is 123.45",), ("number already exists",),
                                ("Rate limit",), ("product_service",), ("boom",), ("ok",)], "reply string")
    got = [(r.category, r.expected_total) for r in billing.reply_triage(df).collect()]
    assert got == [("total_mismatch", D("123.45")), ("duplicate_number", None), ("rate_limit", None),
                   ("service_down", None), ("error", None), ("ok", None)]


def receipts_df(spark, rows):
    return spark.createDataFrame(rows, "casillero string, id string, monto_solicitado decimal(18,2), "
                                       "cuenta_solicitada string, event_id long, arrival timestamp, "
                                       "monto decimal(18,2), cuenta string, referencia string, fecha string, "
                                       "exitosa boolean, readable boolean")


def test_settlement_cases(spark):
    t = lambda m: T(2024, 1, 1, 0, m)
    rows = [
        ("A", "R1", D("100"), "616-1", 1, t(1), D("60"), "6161", "X1", "d", True, True),   # applied
        ("A", "R1", D("100"), "616-1", 2, t(2), D("60"), "6161", "X1", "d", True, True),   # duplicate
        ("A", "R1", D("100"), "616-1", 3, t(3), D("50"), "999", "X2", "d", True, True),    # wrong account
        ("A", "R1", D("100"), "616-1", 4, t(4), D("50"), "6161", "X3", "d", False, True),  # unsuccessful
        ("A", "R1", D("100"), "616-1", 5, t(5), D("50"), "6161", "", "d", True, True),     # applied -> approved
        ("A", "R1", D("100"), "616-1", 6, t(6), D("5"), "6161", "X4", "d", True, True),    # closed
        ("A", "R2", D("100"), "", 7, t(7), D("5"), "1", "Y1", "d", True, False),           # unreadable -> review
        ("A", "R2", D("100"), "", 8, t(8), D("5"), "1", "Y2", "d", True, True),            # closed
        ("A", "R3", D("0"), "", 9, t(9), D("5"), "1", "Z1", "d", True, True),              # requested 0: partial
    ]
    got = {r.event_id: (r.verdict, r.status) for r in settlement.receipt_settlement(receipts_df(spark, rows)).collect()}
    assert [got[i][0] for i in range(1, 10)] == ["applied", "duplicate", "wrong_account", "unsuccessful", "applied",
                                                 "closed", "unreadable", "closed", "applied"]
    assert got[1][1] == "aprobada" and got[7][1] == "en revision" and got[9][1] == "parcial"


def test_billing_run_golden(spark):
    mv = spark.createDataFrame([
        ("1", "f", "M1", "123.0", None, D("101.50")),    # id cleaned -> client 123, invoiced
        ("1", "f", "M2", "nan", None, D("10.00")),       # 'nan' is no id: not pending (Q22)
        ("1", "f", "M3", "555", "", D("10.00")),         # unknown client
        ("1", "f", "M4", "777", None, D("10.00")),       # new client without phone
        ("2", "g", "M5", "123", None, D("10.00")),       # account 2 has no note
        ("1", "f", "M6", "123", " ", D("0.00")),         # zero total
        ("1", "f", "M7", "124", None, D("-5.00")),       # negative -> zero total
        ("1", "f", "M8", "124", "99", D("50.00")),       # already invoiced: not pending
        ("1", "g", "M9", "124", None, D("20.00")),       # invoiced
        ("1", "g", "MA", "124", None, D("20.00")),       # limit reached
    ], "casillero string, source_file string, id_ingreso string, id_cliente string, factura string, "
       "monto decimal(18,2)")
    cl = spark.createDataFrame([
        ("123", "Ana", "Paz", "c1", "5", "5001", "300 1", "a@b.co", 1),
        ("124", "Luis Mora", None, None, "11", "11001", "300 2", "l@b.co", 2),
        ("777", "Eva", "Gil", "c3", "5", "5001", "", "e@b.co", 3),
    ], "identificacion string, nombres string, apellidos string, direccion string, codigo_departamento string, "
       "codigo_ciudad string, telefono string, correo string, ordinal long")
    known = spark.createDataFrame([("124",)], "identificacion string")
    notes = spark.createDataFrame([("1", "nota uno")], "code string, text string")
    reg = spark.createDataFrame([("10", None)], "consecutive string, number string")
    reserved = spark.createDataFrame([(12,)], "number long")
    cfg = billing.BillingConfig(doc_id=1, seller_id=2, payment_id=3, vat_tax_id=4, third_party_id="0",
                                as_of="2024-01-31", number_limit=13)
    run = billing.billing_run(mv, cl, known, notes, reg, cfg, reserved=reserved)
    inv = {r.id_ingreso: (r.number, r.gn1, r.sr02, r.iva, r.invoice_total) for r in run.invoices.collect()}
    assert inv == {"M1": (11, D("100.00"), D("1.26"), D("0.24"), D("101.50")),
                   "M9": (13, D("19.70"), D("0.25"), D("0.05"), D("20.00"))}
    rej = {r.id_ingreso: (r.stage, r.reason) for r in run.rejects.collect()}
    assert rej == {"M3": ("match", "client_not_found"), "M4": ("customer", "empty_phone"),
                   "M5": ("invoice", "no_note"), "M6": ("invoice", "zero_total"),
                   "M7": ("invoice", "zero_total"), "MA": ("number", "limit_reached")}
    cust = {r.id_cliente: r.reason for r in run.new_customers.collect()}
    assert cust == {"123": None, "777": "empty_phone"}
    import json
    p = json.loads([r.payload for r in run.invoices.collect() if r.id_ingreso == "M1"][0])
    assert p["number"] == 11 and p["items"][1]["taxes"] == [{"id": 4}] and "customer" not in p["items"][1]
    assert p["payments"][0]["value"] == 101.5 and p["observations"] == "nota uno"
    summ = {r.casillero: (r.n_read, r.n_pending, r.n_issued, r.n_failed) for r in run.summary.collect()}
    assert summ == {"1": (9, 7, 2, 5), "2": (1, 1, 0, 1)}


def test_billing_release_drops_cache(spark):
    from ledgerloom.plans.billing_queries import _run
    from tests.conftest import SF_SMALL
    run = _run(spark, SF_SMALL)
    n = run.invoices.count()
    assert n > 0 and run._cached and all(f.is_cached for f in run._cached)
    run.release()
    assert run._cached == []
