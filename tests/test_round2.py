"""Cases that real files and tables hold: unequal columns, odd headers, repeated and null keys, large values."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.jsontext import lenient_json
from ledgerloom.functions.numbers import safe_money
from ledgerloom.operators import billing, clients, requests, settlement
from ledgerloom.session import checkpoint_dir
from ledgerloom.sources import headers, readers, sinks


def path_of(spark, name):
    import uuid
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def ledger(spark, accounts):
    return spark.createDataFrame([(str(a), float(k)) for a in accounts for k in range(3)], "casillero string, monto double")


def test_a_smaller_export_replaces_the_larger(spark):
    path = path_of(spark, "export")
    sinks.write_table(ledger(spark, range(20)), path, whole=True)
    sinks.write_table(ledger(spark, range(5)), path, whole=True)
    assert spark.read.parquet(path).count() == 15


def test_any_bucket_count_reads_back(spark):
    path, df = path_of(spark, "buckets"), ledger(spark, range(50))
    sinks.write_table(df, path, buckets=100)
    assert sinks.read_table(spark, path, df.schema, accounts=map(str, range(50)), buckets=100).count() == 150


def test_a_hot_account_is_split(spark):
    path = path_of(spark, "hot")
    df = spark.range(200_000).select(F.lit("1").alias("casillero"), F.col("id").alias("n"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.write_table(df, path)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert spark.read.parquet(path).select(F.input_file_name()).distinct().count() > 1


def test_movement_files_of_any_account_and_columns(spark):
    root = path_of(spark, "movements")
    for name, cols, row in [("ingresos_7.parquet", "casillero string, ID_INGRESO string, `Fecha de Sistema` string", ("7", "a", "01032024")),
                            ("Ingresos_PRUEBA-1_x.parquet", "casillero string, Valor double, `Fecha Sistema` string", ("PRUEBA-1", 5.0, "02032024")),
                            ("ingresos_2x.parquet", "casillero string", ("2",))]:
        spark.createDataFrame([row], cols).write.parquet(f"{root}/source_file={name}")
    accounts = spark.createDataFrame([("7",), ("prueba-1",), ("2",)], "code string")
    for kw in ({}, {"accounts": accounts}):
        got = {r.casillero: r.asDict() for r in readers.load_movement_files(spark, root, **kw).collect()}
        assert set(got) == {"7", "PRUEBA-1"}
        assert got["7"]["id_ingreso"] == "a" and got["PRUEBA-1"]["valor"] == 5.0
        assert all(r["fecha_sistema"] for r in got.values())
    assert readers.load_movement_files(spark, root, acct="7").count() == 1
    assert readers.load_movement_files(spark, root, acct=".").count() == 0


def test_edits_of_repeated_and_null_ids(spark):
    mv = spark.createDataFrame([("1", "f", "x", None, 1), ("1", "f", "x", None, 2), ("1", "f", None, "old", 3)],
                               "casillero string, source_file string, id_ingreso string, id_cliente string, n int")
    ed = spark.createDataFrame([("1", "f", "x", "c1"), ("1", "f", "x", "c1"), ("1", "f", None, "c1")],
                               "casillero string, source_file string, id_ingreso string, nuevo_id_cliente string")
    cl = spark.createDataFrame([("c1",)], "identificacion string")
    out = clients.assignment_apply(mv, ed, cl).collect()
    assert sorted((r.n, r.id_cliente) for r in out) == [(1, "c1"), (2, "c1"), (3, "c1")]


def test_numbers_go_back_to_their_account_and_the_highest_wins(spark):
    mv = spark.createDataFrame([("A", "1", None), ("B", "1", "old")], "casillero string, id_ingreso string, factura string")
    inv = spark.createDataFrame([("A", "1", 99_999), ("A", "1", 100_000)], "casillero string, id_ingreso string, number bigint")
    assert {(r.casillero, r.factura) for r in billing.writeback(mv, inv).collect()} == {("A", "100000"), ("B", "old")}


def test_an_empty_register_numbers_nothing(spark):
    rows = spark.createDataFrame([("A", "f", "1")], "casillero string, source_file string, id_ingreso string")
    rows = rows.select(*[F.col(c) if c in rows.columns else F.lit("0").alias(c) for c in billing.MOVEMENT_KEY])
    none = spark.createDataFrame([], "consecutive string, number string")
    numbered, rejects = billing.assign_numbers(rows, none, None, 100)
    assert numbered.count() == 0 and [r.reason for r in rejects.collect()] == ["register_empty"]


def test_money_is_null_when_too_large_and_keeps_decimals(spark):
    df = spark.createDataFrame([("1e17", Decimal("1234567890123456.78")), ("NaN", None), ("12.345", Decimal("0.01"))], "t string, d decimal(18,2)")
    got = [tuple(r) for r in df.select(safe_money("t"), safe_money("d")).collect()]
    assert got == [(None, Decimal("1234567890123456.78")), (None, None), (Decimal("12.35"), Decimal("0.01"))]


@pytest.mark.parametrize("text,ok", [("abc {no es json} def", False), ('{"a":1} and {"b":2}', False), ('x {"a":1} y', True),
                                     ('```json\n{"a": 1}\n```', True), ("[1,2]", True), ("", False)])
def test_lenient_json_asks_for_valid_json(spark, text, ok):
    assert spark.createDataFrame([(text,)], "t string").select(lenient_json("t").isNotNull()).first()[0] is ok


def test_client_append_keeps_columns_and_the_first_form(spark):
    from tests.conftest import SF_SMALL
    from ledgerloom.sources import adapters as A
    base = A.load(spark, SF_SMALL, "clients").withColumn("extra", F.lit("kept"))
    forms = A.load(spark, SF_SMALL, "client_forms")
    out = clients.append_clients(base, forms.union(forms))
    assert out.where("extra = 'kept'").count() == base.count()
    assert out.count() == clients.append_clients(base, forms).count()


def test_an_update_takes_the_type_of_the_table(spark):
    rows = spark.createDataFrame([("1", "a", Decimal("1.50"))], "casillero string, id string, monto decimal(18,2)")
    upd = spark.createDataFrame([("1", "a", "2.25", 1)], "casillero string, id string, monto string, seq int")
    out = requests.upsert_by_id(rows, upd)
    assert out.schema["monto"].dataType == rows.schema["monto"].dataType and out.first().monto == Decimal("2.25")


def test_headers_become_columns_by_their_exact_text(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0, "d", "p", None, "k")],
                               "`MontoCop` double, `Monto COP` double, `Valor Total` double, monto double, `Descripción` string, "
                               "`Descripcion` string, valor string, ` Valor` string")
    out = headers.apply_headers(df, headers.MOVEMENT_HEADERS)
    got = out.first().asDict()
    assert got == {"monto_cop_compact": 1.0, "monto_cop": 2.0, "valor_total": 3.0, "monto": 4.0, "descripcion": "d",
                   "descripcion_plain": "p", "valor": "k"}
    assert float(billing.with_split(out).first().total_charged) == 1.0
    assert clients.movement_filters(out.withColumn("monto_cop_compact", F.lit(-5.0))).count() == 0


def test_a_client_sheet_is_loaded_and_a_full_name_is_split(spark):
    raw = spark.createDataFrame([("7.0", None, None, "Ana Maria Ruiz", "5", "5001")],
                                "`Identificación (Obligatorio)` string, `Nombres del tercero (Obligatorio)` string, "
                                "`Apellidos del tercero (Obligatorio)` string, `Nombre completo` string, "
                                "`Código departamento/estado` string, `Código ciudad` string")
    row = billing.with_customer_fields(clients.load_clients(raw)).first()
    assert (row.f_identification, row.f_first_name, row.f_last_name) == ("7", "Ana Maria", "Ruiz")
    assert (row.codigo_departamento, row.codigo_ciudad) == ("05", "05001")


@pytest.mark.parametrize("amount,want", [("123.456", ("121.63", "1.53", "0.29")), ("1e17", None), ("1e30", ("0.00",) * 3), ("-3", ("0.00",) * 3),
                                         ("inf", ("0.00",) * 3)])
def test_the_split_starts_from_the_unrounded_total(spark, amount, want):
    row = billing.with_split(spark.createDataFrame([(amount,)], "monto string")).first()
    if want:
        assert tuple(str(x) for x in (row.gn1, row.sr02, row.iva)) == want
    else:
        assert row.gn1 == Decimal("98522167487684729.06")


def test_settlement_starts_from_the_stored_state(spark):
    old = '[{"ruta": "r", "banco": "b", "monto": 10, "fecha": "d", "cuenta": "1", "referencia": "OLD"}]'
    reqs = spark.createDataFrame([("A", "open", Decimal(25), "1", " Parcial ", old, "x", ""), ("A", "shut", Decimal(25), "1", "aprobada", "[]", "", ""),
                                  ("A", "idle", Decimal(25), "1", "pendiente", "nan", "", "")],
                                 "casillero string, id string, monto decimal(18,2), numero_cuenta string, estado string, comprobantes string, "
                                 "fecha_realizado string, fecha_decision string")
    rows = [(1, "shut", "N1", 5), (2, "open", "o l d", 10), (3, "open", "N1", 5), (4, "open", "N2", 10), (5, "open", "N3", 1), (6, "gone", "N4", 1)]
    rec = spark.createDataFrame([("A", r, Decimal(99), "9", e, f"2024-01-0{e} 00:00:00", Decimal(m), "1", ref, "d", True, True) for e, r, ref, m in rows],
                                "casillero string, id string, monto_solicitado decimal(18,2), cuenta_solicitada string, event_id int, arrival string, "
                                "monto decimal(18,2), cuenta string, referencia string, fecha string, exitosa boolean, readable boolean")
    rec = rec.withColumn("arrival", F.col("arrival").cast("timestamp_ntz"))
    out = {r.event_id: r for r in settlement.receipt_settlement(rec, reqs).collect()}
    assert [out[e].verdict for e in range(1, 7)] == ["closed", "duplicate", "applied", "applied", "closed", "unknown_request"]
    assert out[4].paid_after == 25 and out[4].status == "aprobada" and out[1].status == "aprobada" and out[6].status is None
    after = {r.id: r for r in requests.with_receipts(settlement.settle_requests(reqs, rec)).collect()}
    assert set(after) == {"open", "shut", "idle"}
    assert [x.referencia for x in after["open"].receipts] == ["OLD", "N1", "N2"]
    assert (after["open"].estado, after["open"].monto_abonado, after["open"].fecha_decision) == ("aprobada", 25, "2024-01-04")
    assert after["open"].fecha_realizado == "x" and after["idle"].comprobantes == "nan" and after["idle"].estado == "pendiente"


def test_large_number_ranges_rank_alike(spark, monkeypatch):
    from ledgerloom.operators import sequence
    taken = spark.createDataFrame([(3,), (5,), (5,)], "number bigint")
    few = sorted(map(tuple, sequence.rank_ascending_range(spark, F.lit(2), 9, taken).collect()))
    monkeypatch.setattr(sequence, "BROADCAST_NUMBERS", 5)
    assert sorted(map(tuple, sequence.rank_ascending_range(spark, F.lit(2), 9, taken).collect())) == few
    assert few == [(2, 1), (4, 2), (6, 3), (7, 4), (8, 5), (9, 6)]


def test_kept_frames_are_released(spark):
    from ledgerloom.operators import sequence
    sequence.release()
    df = sequence.ranked_within(spark.range(10), [], ["id"])
    assert df.count() == 10 and sequence._KEPT[-1].is_cached
    kept = sequence._KEPT[-1]
    sequence.release()
    assert not kept.is_cached and not sequence._KEPT
