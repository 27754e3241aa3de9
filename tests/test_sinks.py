"""Sources and sinks: formats, partitioned export, versioned replace, appends."""

import uuid

from pyspark.sql import functions as F

from ledgerloom import schemas
from ledgerloom.operators import clients, reports
from ledgerloom.sources import adapters as A
from ledgerloom.sources import readers, sinks
from tests.conftest import SF_SMALL


def _root(spark):
    return sinks.scratch_path(spark, "test", uuid.uuid4().hex[:8])


def test_export_roundtrip_all_formats(spark):
    rep = reports.consolidated(A.load(spark, SF_SMALL, "ledger"))
    n = rep.count()
    for fmt in ("parquet", "csv", "json"):
        back = sinks.export_report(rep, f"{_root(spark)}/{fmt}", fmt=fmt)
        assert back.count() == n
        assert dict(back.dtypes)["fecha"] == "date"


def test_versioned_replace_keeps_previous_until_new_is_complete(spark):
    root = _root(spark)
    req = readers.load_requests(A.load(spark, SF_SMALL, "requests"))
    assert sinks.read_current(spark, root, schemas.REQUESTS).count() == 0
    sinks.replace_table(req, root)
    upd = req.withColumn("estado", F.lit("aprobada"))
    sinks.replace_table(upd, root)
    assert sinks.versions(spark, root) == [1, 2]
    cur = sinks.read_current(spark, root, schemas.REQUESTS)
    assert cur.filter(F.col("estado") != "aprobada").count() == 0 and cur.count() == req.count()


def test_append_log(spark):
    path = f"{_root(spark)}/rejects"
    df = spark.createDataFrame([("a", "match", "client_not_found")], schemas.REJECTS)
    sinks.append_log(df, path)
    sinks.append_log(df, path)
    assert spark.read.parquet(path).count() == 2


def test_movement_files_pattern(spark):
    from ledgerloom.plans.source_queries import movement_file_set
    root = movement_file_set(spark, SF_SMALL)
    names = {r.source_file for r in readers.load_movement_files(spark, root).select("source_file").distinct().collect()}
    assert names and all(n.lower().startswith("ingresos_") and "x.parquet" not in n for n in names)
    one = readers.load_movement_files(spark, root, acct="1")
    assert {r.casillero for r in one.select("casillero").distinct().collect()} == {"1"}


def test_fold_headers_and_sysdate_column():
    assert readers.fold_header("  Fecha  de\u00a0Carga ") == "fecha de carga"
    assert readers.fold_header("Fécha") == "fecha"
    assert readers.sysdate_columns(["x", "sistema y fecha", "Fecha  del Sistema"]) == ["Fecha  del Sistema", "sistema y fecha"]
    assert readers.sysdate_columns(["SISTEMA fecha"]) == ["SISTEMA fecha"]
    assert readers.sysdate_columns(["fecha"]) == []


def test_append_clients(spark):
    base = A.load(spark, SF_SMALL, "clients")
    forms = A.load(spark, SF_SMALL, "client_forms")
    valid = clients.client_validation(forms, clients.clients_clean(base)).filter(F.col("reason").isNull()).count()
    out = clients.append_clients(base, forms)
    assert out.count() == base.count() + valid


def test_bucketed_layout_and_pruned_read(spark):
    rep = reports.consolidated(A.load(spark, SF_SMALL, "ledger"))
    path = f"{_root(spark)}/bucketed"
    sinks.write_table(sinks.for_export(rep), path)
    schema = sinks.for_export(rep).schema
    accts = [r.casillero for r in rep.select("casillero").distinct().limit(3).collect()]
    got = sinks.read_table(spark, path, schema, accounts=accts)
    assert got.count() == rep.filter(F.col("casillero").isin(accts)).count()
    # the literal bucket equals Spark's xxhash64-based bucket
    exp = {r.c: r.b for r in spark.createDataFrame([(a,) for a in accts], "c string")
           .select("c", sinks.account_bucket("c").alias("b")).collect()}
    assert exp == {a: spark.range(1).select(sinks.bucket_of(a)).first()[0] for a in accts}
    plan = spark.sparkContext._jvm.PythonSQLUtils.explainString(got._jdf.queryExecution(), "formatted")
    scan = plan[plan.index("Scan parquet"):]
    assert "PartitionFilters: [casillero_bucket" in scan and "PushedFilters: [In(casillero" in scan


def test_read_files_permissive(spark):
    from pyspark.sql import types as T
    mv = A.load(spark, SF_SMALL, "movements").select("id_ingreso", F.col("monto").cast("string").alias("monto"))
    n = mv.count()
    # every 10th line gets an amount that is no number
    lines = mv.withColumn("_i", F.monotonically_increasing_id()).select(
        F.concat_ws(",", "id_ingreso",
                    F.when(F.col("_i") % 10 == 0, F.lit("abc")).otherwise(F.col("monto"))).alias("value"))
    path = f"{_root(spark)}/csv"
    lines.write.text(path)
    schema = T.StructType([T.StructField("id_ingreso", T.StringType()), T.StructField("monto", T.DecimalType(18, 2))])
    rows, rejects = readers.read_files(spark, path, schema, "csv", header=False)
    bad = rejects.count()
    assert bad > 0 and rows.count() + bad == n
    assert rows.filter(F.col("monto").isNull()).count() == 0
