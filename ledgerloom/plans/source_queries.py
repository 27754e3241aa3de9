"""Source and sink queries: typed loads, conforming, file sets, exports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom import schemas
from ledgerloom.operators import reports
from ledgerloom.plans.client_queries import NORMALISED
from ledgerloom.plans.ledger_queries import INCOME_BODY, INCOME_SELECT
from ledgerloom.plans.oracle import with_views
from ledgerloom.plans.registry import query
from ledgerloom.sources import adapters as A
from ledgerloom.sources import readers, sheets, sinks


def _money(x: str) -> str:
    return f"(CASE WHEN isfinite(try_cast({x} AS DOUBLE)) THEN CAST(try_cast({x} AS DOUBLE) AS DECIMAL(18,2)) END)"


LEDGER_LOAD_SQL = with_views(["ledger_raw", "accounts"], f"""
SELECT l.casillero, l.tipo, try_cast(l.fecha AS TIMESTAMP) AS fecha,
       CASE WHEN l.libro = 'cop' THEN coalesce(try_cast(l.fecha_carga AS TIMESTAMP), try_cast(l.fecha AS TIMESTAMP))
            ELSE try_cast(l.fecha_carga AS TIMESTAMP) END AS fecha_carga,
       {_money('l.monto')} AS monto, l.motivo, l.orden, l.producto,
       CASE WHEN a.usd_rate AND isfinite(try_cast(l.trm AS DOUBLE)) THEN try_cast(l.trm AS DOUBLE) + 100 END AS trm,
       l.libro
FROM ledger_raw l LEFT JOIN accounts a ON l.casillero = a.code""")


@query("ledger_load", LEDGER_LOAD_SQL)
def q_ledger_load(spark, sf):
    return readers.load_ledger(A.load(spark, sf, "ledger_raw"), A.load(spark, sf, "accounts"))


# Spreadsheet headers of the raw ledger (accents, case, double spaces, NBSP).
MESSY_HEADERS = {"casillero": "Casillero", "tipo": "TIPO", "fecha": "Fécha", "fecha_carga": "Fecha de  Carga",
                 "monto": "Monto ", "motivo": "Motivo", "orden": "Orden", "producto": "Nombre del producto",
                 "libro": "Libro Contable"}
HEADER_TARGETS = {"fecha de carga": "fecha_carga", "nombre del producto": "producto"}


@query("schema_conform", with_views(["ledger_raw"], """
SELECT casillero, tipo, try_cast(fecha AS TIMESTAMP) AS fecha, try_cast(fecha_carga AS TIMESTAMP) AS fecha_carga,
       try_cast(monto AS DECIMAL(18,2)) AS monto, motivo, orden, producto, CAST(NULL AS DOUBLE) AS trm,
       libro AS libro_contable
FROM ledger_raw"""))
def q_schema_conform(spark, sf):
    raw = A.load(spark, sf, "ledger_raw").drop("trm")
    messy = raw.select(*[F.col(c).alias(MESSY_HEADERS[c]) for c in raw.columns])
    return readers.conform(readers.fold_headers(messy, HEADER_TARGETS), schemas.LEDGER, keep_extra=True)


@query("movements_union", with_views(["movements"], """
SELECT casillero, id_ingreso, id_cliente, factura, monto, referencia, fecha_sistema, source_file
FROM movements WHERE source_file = 'ingresos_a.parquet'
UNION ALL BY NAME
SELECT casillero, id_ingreso, id_cliente, factura, monto AS valor, referencia AS descripcion, fecha_sistema, source_file
FROM movements WHERE source_file = 'ingresos_b.parquet'"""))
def q_movements_union(spark, sf):
    mv = A.load(spark, sf, "movements")
    a = mv.filter(F.col("source_file") == "ingresos_a.parquet")
    b = (mv.filter(F.col("source_file") == "ingresos_b.parquet")
         .withColumnRenamed("monto", "valor").withColumnRenamed("referencia", "descripcion"))
    return a.unionByName(b, allowMissingColumns=True)


# Headers of the two kinds of movement files, as sheets write them.
PLAIN_HEADERS = {"id_ingreso": "ID_INGRESO", "id_cliente": "Id_cliente", "factura": "Factura", "monto": "MontoCop",
                 "referencia": "REFERENCIA", "fecha_sistema": "Fecha de Sistema"}
BANK_HEADERS = {"id_ingreso": "Id_Ingreso", "id_cliente": "Id_cliente", "monto": "Valor", "referencia": "Descripción",
                "fecha_sistema": "Fecha Sistema"}


def movement_file_set(spark, sf):
    """Movements written as one folder per source file, with the headers and
    columns of its kind: 'ingresos_<acct>.parquet', 'Ingresos_<acct>_Davivienda.parquet',
    account 3 as 'ingresos_P-3.parquet', and an 'ingresos_2x.parquet' that the name rule must skip.
    """
    root = f"{sinks.scratch_path(spark, 'files', sinks.tag(sf), 'movements')}-{uuid.uuid4().hex}"
    mv = A.load(spark, sf, "movements").drop("source_file")
    bank = F.substring("id_ingreso", 9, 2) >= "15"
    acct = F.when(F.col("casillero") == "3", "P-3").otherwise(F.col("casillero"))
    plain = mv.filter(~bank).withColumn("source_file", F.concat(
        F.lit("ingresos_"), acct, F.when(F.col("casillero") == "2", "x").otherwise(""), F.lit(".parquet")))
    banks = mv.filter(bank).drop("factura").withColumn("source_file", F.concat(F.lit("Ingresos_"), acct, F.lit("_Davivienda.parquet")))
    for df, headers in ((plain, PLAIN_HEADERS), (banks, BANK_HEADERS)):
        df.withColumnsRenamed(headers).write.mode("append").partitionBy("source_file").parquet(root)
    return root


@query("movements_load", with_views(["movements", "accounts"], f"""
, m AS (SELECT *, substr(id_ingreso, 9, 2) >= '15' AS bank, CASE casillero WHEN '3' THEN 'P-3' ELSE casillero END AS acct,
               {NORMALISED} AS day_text FROM movements)
SELECT casillero, id_ingreso, id_cliente, CASE WHEN NOT bank THEN factura END AS factura,
       CASE WHEN NOT bank THEN monto END AS monto_cop_compact, CASE WHEN bank THEN monto END AS valor,
       CASE WHEN NOT bank THEN referencia END AS referencia, CASE WHEN bank THEN referencia END AS descripcion,
       CASE WHEN bank THEN fecha_sistema ELSE day_text END AS fecha_sistema,
       CASE WHEN bank THEN 'Ingresos_' || acct || '_Davivienda.parquet' ELSE 'ingresos_' || acct || '.parquet' END AS source_file
FROM m WHERE casillero IN (SELECT code FROM accounts) AND (bank OR casillero <> '2')"""))
def q_movements_load(spark, sf):
    accounts = A.load(spark, sf, "accounts").select(F.when(F.col("code") == "3", "p-3").otherwise(F.col("code")).alias("code"))
    return readers.load_movement_files(spark, movement_file_set(spark, sf), accounts=accounts)


@query("report_export", with_views(["ledger"], INCOME_BODY + f"""
{INCOME_SELECT}, 'Ingreso' AS tipo FROM inc
UNION ALL
SELECT casillero, fecha, CAST(monto AS DECIMAL(38,2)), NULL, orden, producto, 'Egreso' FROM ledger
WHERE fecha_carga IS NOT NULL AND trim(tipo) = 'Egreso'""".replace(
    "SELECT casillero, fecha,", "SELECT casillero, CAST(fecha AS DATE) AS fecha,")))
def q_report_export(spark, sf):
    path = sinks.scratch_path(spark, "exports", sinks.tag(sf), "consolidated")
    return sinks.export_report(reports.consolidated(A.load(spark, sf, "ledger")), path)


EDITED_ACCOUNTS = ("1", "2")
MOVEMENT_FIELDS = "casillero string, id_ingreso string, id_cliente string, factura string, monto decimal(18,2)"


def two_file_sets(spark, sf):
    """The movements as one folder a source file, and a second set with the edited files of some accounts."""
    root = f"{sinks.scratch_path(spark, 'file-sets', sinks.tag(sf))}-{uuid.uuid4().hex}"
    mv = A.load(spark, sf, "movements").select(
        "casillero", "id_ingreso", "id_cliente", "factura", "monto",
        F.concat(F.lit("ingresos_"), F.col("casillero"), F.lit("_"), F.substring("source_file", 10, 1), F.lit(".parquet")).alias("source_file"))
    edited = mv.filter(F.col("casillero").isin(*EDITED_ACCOUNTS) & F.col("source_file").endswith("_a.parquet") & F.col("id_cliente").isNotNull())
    mv.repartitionByRange("source_file", "id_ingreso").write.partitionBy("source_file").parquet(f"{root}/loaded")
    (edited.withColumn("id_cliente", F.concat("id_cliente", F.lit("-e"))).repartitionByRange("source_file", "id_ingreso")
     .write.partitionBy("source_file").parquet(f"{root}/edited"))
    return f"{root}/loaded", f"{root}/edited"


@query("file_set_merge", with_views(["movements"], f"""
, m AS (SELECT *, 'ingresos_' || casillero || '_' || substr(source_file, 10, 1) || '.parquet' AS f FROM movements),
  e AS (SELECT * FROM m WHERE casillero IN {EDITED_ACCOUNTS} AND f LIKE '%_a.parquet' AND id_cliente IS NOT NULL)
SELECT casillero, id_ingreso, id_cliente, factura, monto, f AS source_file FROM m WHERE f NOT IN (SELECT f FROM e)
UNION ALL SELECT casillero, id_ingreso, id_cliente || '-e', factura, monto, f FROM e"""))
def q_file_set_merge(spark, sf):
    return readers.read_file_sets(spark, T.StructType.fromDDL(MOVEMENT_FIELDS), *two_file_sets(spark, sf))


@query("ledger_from_sheets", LEDGER_LOAD_SQL)
def q_ledger_from_sheets(spark, sf):
    """The ledger written as workbooks, one and more a book, and loaded from them; a broken file beside them is skipped."""
    path = f"{sinks.scratch_path(spark, 'sheets', sinks.tag(sf))}-{uuid.uuid4().hex}"
    raw = A.load(spark, sf, "ledger_raw")
    order = raw.withColumn("_file", F.concat(F.lit("libro_"), F.col("libro")))
    sheets.write_sheets(order.repartitionByRange("_file", "casillero", "orden").sortWithinPartitions("_file"), path, "_file")
    sinks.write_bytes(spark, f"{path}/broken.xlsx", b"not a workbook")
    rows, _ = sheets.read_sheets(spark, path, {c: c for c in raw.columns})
    return readers.load_ledger(rows.select(*raw.columns), A.load(spark, sf, "accounts"))
