"""Adapter views: the domain tables derived from the driver's parquet tables.

Each adapter is one SQL text with ``{table}`` placeholders.  Spark binds them
to session views over the parquet files of one folder; the DuckDB oracle binds
them to its pre-registered views of the same name.
The text is the same for both engines, so an oracle and the library read the
same rows.  All adapters scale with the driver tables.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.session import grow_shuffles

DRIVER_TABLES = ("region nation customer supplier part orders lineitem events documents "
                 "embeddings pages benchmark labels conversations").split()

ADAPTERS: dict[str, str] = {}

# --- ledger: one row per movement; status F/O/P -> Ingreso/Egreso/Total ----
ADAPTERS["ledger"] = """
SELECT CAST(o_custkey AS VARCHAR(20)) AS casillero,
       CASE o_orderstatus WHEN 'F' THEN 'Ingreso' WHEN 'O' THEN 'Egreso' ELSE 'Total' END AS tipo,
       o_orderdate AS fecha, o_orderdate AS fecha_carga,
       CAST(CASE WHEN o_orderstatus = 'P' THEN o_totalprice - 250000 ELSE o_totalprice END AS DECIMAL(18,2)) AS monto,
       CASE o_orderpriority WHEN '1-URGENT' THEN ' ingreso  extra ' WHEN '2-HIGH' THEN 'Ingresos-Extra'
            WHEN '3-MEDIUM' THEN 'devolución' WHEN '5-LOW' THEN NULL ELSE 'Pago' END AS motivo,
       concat('Consignacion', CAST(o_orderkey AS VARCHAR(20))) AS orden,
       CASE WHEN o_orderkey % 11 = 0 THEN 'Total' WHEN o_orderkey % 13 = 0 THEN ' parcial '
            ELSE concat('Producto ', CAST(o_orderkey AS VARCHAR(20))) END AS producto,
       CAST(3900 + o_orderkey % 300 AS DOUBLE) AS trm
FROM {orders}
"""

# --- raw ledger: the same rows as untyped text, as a spreadsheet export ----
ADAPTERS["ledger_raw"] = """
SELECT CAST(o_custkey AS VARCHAR(20)) AS casillero,
       CASE o_orderstatus WHEN 'F' THEN 'Ingreso' WHEN 'O' THEN 'Egreso' ELSE 'Total' END AS tipo,
       CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE CAST(o_orderdate AS VARCHAR(30)) END AS fecha,
       CASE WHEN o_orderkey % 23 = 0 THEN 'sin fecha' WHEN o_orderkey % 7 = 0 THEN NULL
            ELSE CAST(o_orderdate AS VARCHAR(30)) END AS fecha_carga,
       CASE WHEN o_orderkey % 19 = 0 THEN 'n/a' WHEN o_orderkey % 37 = 0 THEN '1,000'
            ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR(30)) END AS monto,
       CASE o_orderpriority WHEN '1-URGENT' THEN ' ingreso  extra ' WHEN '3-MEDIUM' THEN 'devolución'
            ELSE 'Pago' END AS motivo,
       concat('Consignacion', CAST(o_orderkey AS VARCHAR(20))) AS orden,
       concat('Producto ', CAST(o_orderkey AS VARCHAR(20))) AS producto,
       CASE WHEN o_orderkey % 17 = 0 THEN 'x' ELSE CAST(3900 + o_orderkey % 300 AS VARCHAR(20)) END AS trm,
       CASE WHEN o_orderkey % 7 = 0 THEN 'cop' ELSE 'usd' END AS libro
FROM {orders}
"""

# --- COP side ledger: extra expenses and the 4x1000 levy ------------------
ADAPTERS["cop_ledger"] = """
SELECT CAST(o_custkey AS VARCHAR(20)) AS casillero,
       CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_orderdate END AS fecha,
       concat('Gasto ', o_orderpriority) AS descripcion,
       CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 0.01 AS DECIMAL(18,2)) AS egreso_extra_cop,
       CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 0.004 AS DECIMAL(18,2)) AS gmf_4x1000_cop
FROM {orders}
WHERE o_orderstatus <> 'F'
"""

# --- payment requests: one per order, a seventh of them withdrawals -------
_REQ_SUM = "CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(18,2))"
_REQ_HALF = "CAST(CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) * 0.5 AS DECIMAL(18,2)) AS VARCHAR(30))"
_K = "CAST(l_orderkey AS VARCHAR(20))"
_CTA = "CAST(l_orderkey % 100000 AS VARCHAR(20))"
ADAPTERS["requests"] = """
SELECT CAST(CASE WHEN l_orderkey % 2 = 0 THEN o_custkey ELSE o_custkey + 1 END AS VARCHAR(20)) AS casillero,
       concat('Consignacion', <K>) AS id,
       concat('Pago ', <K>) AS descripcion,
       <SUM> AS monto,
       CAST(CAST(max(o_orderdate) AS DATE) AS VARCHAR(10)) AS fecha,
       CASE WHEN l_orderkey % 7 = 0 THEN 'Retiro' WHEN l_orderkey % 2 = 0 THEN 'Nomina' ELSE 'Proveedor' END AS tipo,
       CASE l_orderkey % 5 WHEN 0 THEN 'pendiente' WHEN 1 THEN 'parcial' WHEN 2 THEN 'en revision'
            WHEN 3 THEN ' Aprobada ' ELSE 'rechazada' END AS estado,
       CASE l_orderkey % 6
            WHEN 0 THEN NULL
            WHEN 1 THEN '[]'
            WHEN 2 THEN concat('[{"ruta": "r/', <K>, '_1.png", "banco": "B1", "monto": ', <HALF>,
                               ', "fecha": "2024-01-01", "cuenta": "', <CTA>, '", "referencia": "REF ', <K>,
                               '"}, {"ruta": "r/', <K>, '_2.png", "banco": "B2", "monto": "', <HALF>,
                               '", "fecha": "2024-01-02", "cuenta": "', <CTA>, '", "referencia": "REF ', <K>, 'B"}]')
            WHEN 3 THEN concat('{"ruta": "r/', <K>, '.png", "monto": 10}')
            WHEN 4 THEN 'no es json'
            ELSE concat('[{"ruta": "r/', <K>, '.png", "banco": "B3", "monto": "abc", "fecha": " 2024-01-03 ", "cuenta": "',
                        <CTA>, '", "referencia": ""}]')
       END AS comprobantes,
       CASE WHEN l_orderkey % 7 = 0 THEN CAST(o_custkey + 2 AS VARCHAR(20)) END AS mayorista_retira,
       CASE WHEN l_orderkey % 7 = 0 THEN concat('retiro', <K>) END AS id_retiro,
       CASE WHEN l_orderkey % 7 = 0 THEN CAST(l_orderkey % 4 AS DOUBLE) * 0.5 END AS comision_pct,
       CASE WHEN l_orderkey % 7 = 0 THEN
            CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) * (100 + CAST(l_orderkey % 4 AS DECIMAL(9,4)) * 0.5) * 0.01
                 AS DECIMAL(18,2)) END AS egreso_retiro,
       <CTA> AS numero_cuenta
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
GROUP BY l_orderkey, o_custkey
""".replace("<SUM>", _REQ_SUM).replace("<HALF>", _REQ_HALF).replace("<K>", _K).replace("<CTA>", _CTA)

# --- receipts as arrival events (one per driver event) -------------------
ADAPTERS["receipts"] = """
SELECT CAST(user_id % 10 AS VARCHAR(20)) AS casillero,
       concat('Consignacion', CAST(user_id AS VARCHAR(20))) AS id,
       CAST(5000 AS DECIMAL(18,2)) AS monto_solicitado, '616-184510-29' AS cuenta_solicitada,
       event_id, ts AS arrival, CAST(event_id % 900 + 1 AS DECIMAL(18,2)) AS monto,
       CASE WHEN event_type = 'view' THEN '999' ELSE '61618451029' END AS cuenta,
       CASE WHEN event_id % 37 = 0 THEN '' ELSE concat('REF ', CAST(event_id % 900 AS VARCHAR(20))) END AS referencia,
       '2024-01-01' AS fecha,
       event_type <> 'error' AS exitosa,
       NOT (event_type = 'signup' AND event_id % 50 = 0) AS readable
FROM {events}
"""

# --- stored requests that the receipts belong to: some closed, some with
#     receipts accepted earlier, users who first signed up without a request -
ADAPTERS["open_requests"] = """
SELECT CAST(user_id % 10 AS VARCHAR(20)) AS casillero,
       concat('Consignacion', CAST(user_id AS VARCHAR(20))) AS id,
       CAST(CASE WHEN user_id % 11 = 0 THEN 0 ELSE 2000 + user_id % 7 * 500 END AS DECIMAL(18,2)) AS monto,
       CASE WHEN user_id % 9 = 0 THEN '' ELSE '616-184510-29' END AS numero_cuenta,
       CASE user_id % 6 WHEN 0 THEN 'aprobada' WHEN 1 THEN ' Parcial ' WHEN 2 THEN 'en revision' WHEN 3 THEN 'parcial'
            ELSE 'pendiente' END AS estado,
       CASE WHEN user_id % 3 = 1 THEN concat('[{"ruta": "r/1.png", "banco": "B1", "monto": ', CAST(user_id % 900 + 1 AS VARCHAR(20)),
                 ', "fecha": " 2024-01-01", "cuenta": "616 184510 29", "referencia": "ref', CAST(user_id % 900 AS VARCHAR(20)), '"}]')
            WHEN user_id % 4 = 0 THEN 'nan' ELSE '[]' END AS comprobantes,
       CASE WHEN user_id % 2 = 0 THEN '2023-12-01' ELSE '' END AS fecha_realizado,
       '' AS fecha_decision
FROM {events}
GROUP BY user_id
HAVING min_by(event_type, event_id) <> 'signup'
"""

# --- bank movements of accounts 0..3, two source files -------------------
ADAPTERS["movements"] = """
SELECT CAST(o_custkey % 4 AS VARCHAR(20)) AS casillero,
       concat(substr(CAST(max(l_shipdate) AS VARCHAR(30)), 1, 10), '-', CAST(l_orderkey AS VARCHAR(20)), '-', CAST(l_linenumber AS VARCHAR(20))) AS id_ingreso,
       CASE l_linenumber WHEN 7 THEN NULL WHEN 6 THEN ' ' WHEN 5 THEN concat(CAST(o_custkey AS VARCHAR(20)), '.0')
            WHEN 4 THEN '999999999' ELSE CAST(o_custkey AS VARCHAR(20)) END AS id_cliente,
       CASE WHEN min(l_returnflag) = 'A' THEN CAST(l_orderkey AS VARCHAR(20)) WHEN min(l_returnflag) = 'N' THEN '' END AS factura,
       CAST(max(CASE WHEN l_discount >= 0.1 THEN -l_extendedprice ELSE l_extendedprice END) AS DECIMAL(18,2)) AS monto,
       CASE WHEN l_orderkey % 17 = 0 THEN ' abono intereses ahorros' ELSE concat('REF', CAST(l_orderkey AS VARCHAR(20))) END AS referencia,
       CASE WHEN l_orderkey % 3 = 0 THEN 'nan' WHEN l_orderkey % 3 = 1 THEN '7102025' ELSE '07-10-2025' END AS fecha_sistema,
       CASE WHEN l_orderkey % 2 = 0 THEN 'ingresos_a.parquet' ELSE 'ingresos_b.parquet' END AS source_file
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
GROUP BY l_orderkey, l_linenumber, o_custkey
"""

# --- client master data -------------------------------------------------
ADAPTERS["clients"] = """
SELECT CASE WHEN c_custkey % 9 = 0 THEN concat(CAST(c_custkey AS VARCHAR(20)), '.0') ELSE CAST(c_custkey AS VARCHAR(20)) END AS identificacion,
       CASE WHEN c_custkey % 5 = 0 THEN concat('Ana Maria ', n_name) ELSE 'Luis' END AS nombres,
       CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 6 = 0 THEN ' nan ' ELSE n_name END AS apellidos,
       c_mktsegment AS direccion,
       CASE WHEN c_custkey % 23 = 0 THEN '0' ELSE CAST(c_nationkey + 1 AS VARCHAR(20)) END AS codigo_departamento,
       CASE WHEN c_custkey % 29 = 0 THEN NULL ELSE concat(CAST((c_nationkey + 1) * 100 AS VARCHAR(20)), '.0') END AS codigo_ciudad,
       CASE WHEN c_custkey % 31 = 0 THEN '' ELSE concat('+57 300-', CAST(c_custkey AS VARCHAR(20))) END AS telefono,
       CASE WHEN c_custkey % 7 = 0 THEN 'bad mail' ELSE concat('c', CAST(c_custkey AS VARCHAR(20)), '@example.org') END AS correo,
       c_custkey AS ordinal
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
"""

# --- provider's invoice register: numbers below 150,000 at any size, so
#     there is room up to the legal limit -----------------------------------
ADAPTERS["invoice_register"] = """
SELECT CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderkey % 150000 AS VARCHAR(20)) END AS consecutive,
       CASE WHEN o_orderkey % 50 = 0 THEN 'FV-x' ELSE CAST(o_orderkey % 150000 AS VARCHAR(20)) END AS number
FROM {orders}
"""

# --- account dimension: code, display name, sheet, override, USD policy --
ADAPTERS["accounts"] = """
SELECT CAST(c_custkey AS VARCHAR(20)) AS code,
       c_name AS name,
       concat(CAST(c_custkey AS VARCHAR(20)), ' - ', c_name) AS sheet,
       CASE WHEN c_custkey % 13 = 0 THEN concat('Cliente ', CAST(c_custkey AS VARCHAR(20))) END AS override,
       c_mktsegment = 'BUILDING' AS usd_rate
FROM {customer}
"""

# --- invoice note per billing account (account 3 has none) ---------------
ADAPTERS["notes"] = """
SELECT CAST(n_nationkey AS VARCHAR(20)) AS code,
       concat('Compras pagadas por medio de ', n_name, '.') AS text
FROM {nation}
WHERE n_nationkey <> 3
"""

# --- identifications the accounting provider already knows ---------------
ADAPTERS["known_customers"] = """
SELECT CAST(c_custkey AS VARCHAR(20)) AS identificacion
FROM {customer}
WHERE c_acctbal > 4000
"""

# --- provider replies per invoice attempt --------------------------------
ADAPTERS["reply_log"] = """
SELECT concat(substr(CAST(l_shipdate AS VARCHAR(30)), 1, 10), '-', CAST(l_orderkey AS VARCHAR(20)), '-', CAST(l_linenumber AS VARCHAR(20))) AS id_ingreso,
       l_linenumber AS attempt,
       CASE l_orderkey % 7
            WHEN 0 THEN concat('{"Errors":[{"Code":"invalid_total_payments","Message":"The total payments must be equal to the total invoice. The total invoice calculated is ',
                               CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR(30)), '"}]}')
            WHEN 1 THEN 'The number already exists'
            WHEN 2 THEN '{"Errors":[{"Code":"already_exists"}]}'
            WHEN 3 THEN 'requests_limit reached'
            WHEN 4 THEN 'product_service down'
            WHEN 5 THEN 'ok'
            ELSE 'Error desconocido' END AS reply
FROM {lineitem}
"""

# --- replies to the attempts at an invoice (attempt 0: to every one; no
#     row: accepted) ----------------------------------------------------------
ADAPTERS["provider_replies"] = """
SELECT id_ingreso, 1 AS attempt,
       CASE CAST(split_part(id_ingreso, '-', 4) AS BIGINT) % 7
            WHEN 0 THEN concat('{"Errors":[{"Code":"invalid_total_payments","Message":"The total invoice calculated is ',
                               CAST(monto + 0.01 AS VARCHAR(30)), '"}]}')
            WHEN 1 THEN 'The number already exists'
            WHEN 2 THEN 'requests_limit reached'
            WHEN 3 THEN CASE WHEN split_part(id_ingreso, '-', 5) = '1' THEN 'Error desconocido' ELSE 'product_service down' END
            ELSE 'ok' END AS reply
FROM (""" + ADAPTERS["movements"] + """) m
UNION ALL
SELECT id_ingreso, 2 AS attempt,
       CASE CAST(split_part(id_ingreso, '-', 4) AS BIGINT) % 7
            WHEN 0 THEN CASE WHEN split_part(id_ingreso, '-', 5) = '2' THEN 'invalid_total_payments' ELSE 'ok' END
            WHEN 1 THEN '{"Errors":[{"Code":"already_exists"}]}'
            ELSE 'invalid_total_payments: calculated is 12.50' END AS reply
FROM (""" + ADAPTERS["movements"] + """) m
WHERE split_part(id_ingreso, '-', 5) IN ('1', '2')
UNION ALL
SELECT id_ingreso, 0 AS attempt, 'Rate limit' AS reply
FROM (""" + ADAPTERS["movements"] + """) m
WHERE monto < 1000
"""

# --- numbers the provider has that neither register nor movements know ----
ADAPTERS["provider_numbers"] = """
SELECT DISTINCT (SELECT max(o_orderkey % 150000) FROM {orders}) + o_custkey % 997 * 7 AS number
FROM {orders}
"""

# --- free-text replies holding JSON (fenced, embedded, missing) ----------
ADAPTERS["model_replies"] = """
SELECT event_id,
       CASE event_id % 5
            WHEN 0 THEN props
            WHEN 1 THEN concat('```json', chr(10), props, chr(10), '```')
            WHEN 2 THEN concat('Datos leidos: ', props, ' fin')
            WHEN 3 THEN concat('  ```', props, '```  ')
            ELSE 'sin datos' END AS reply
FROM {events}
"""

# --- request / withdrawal forms filled in by the administrator -----------
ADAPTERS["request_forms"] = """
SELECT CAST(o_custkey AS VARCHAR(20)) AS casillero,
       l_orderkey * 8 + l_linenumber AS form_id,
       CASE WHEN l_linenumber = 1 THEN '' ELSE concat('Pago ', CAST(l_partkey AS VARCHAR(20))) END AS descripcion,
       CASE WHEN l_linenumber = 2 THEN CAST(0 AS DECIMAL(18,2)) ELSE CAST(l_extendedprice AS DECIMAL(18,2)) END AS monto,
       CASE WHEN l_linenumber = 3 THEN ' ' ELSE CAST(l_suppkey AS VARCHAR(20)) END AS numero_cuenta,
       CASE WHEN l_linenumber % 2 = 0 THEN 'Nomina' ELSE 'Proveedor' END AS tipo,
       CASE WHEN l_orderkey % 5 <> 0 THEN substr(CAST(l_shipdate AS VARCHAR(30)), 1, 10) END AS fecha,
       CASE WHEN l_returnflag = 'R' THEN CAST(CASE WHEN l_linenumber = 4 THEN o_custkey ELSE o_custkey + 3 END AS VARCHAR(20)) END
            AS mayorista_retira,
       CASE WHEN l_returnflag = 'R' THEN CAST(l_orderkey % 3 AS DOUBLE) END AS comision_pct
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
"""

# --- manual decisions on urgent / high requests (urgent settled ones twice,
#     some for an unknown account) ------------------------------------------
ADAPTERS["decisions"] = """
SELECT CASE WHEN o_orderpriority = '2-HIGH' AND o_orderstatus = 'P' THEN 'x' ELSE
            CAST(CASE WHEN o_orderkey % 2 = 0 THEN o_custkey ELSE o_custkey + 1 END AS VARCHAR(20)) END AS casillero,
       concat('Consignacion', CAST(o_orderkey AS VARCHAR(20))) AS id,
       CASE WHEN o_totalprice > 200000 THEN 'aprobada' ELSE 'rechazada' END AS estado,
       CAST(CAST(o_orderdate AS DATE) AS VARCHAR(10)) AS fecha_decision,
       1 AS seq
FROM {orders} WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')
UNION ALL
SELECT CAST(CASE WHEN o_orderkey % 2 = 0 THEN o_custkey ELSE o_custkey + 1 END AS VARCHAR(20)) AS casillero,
       concat('Consignacion', CAST(o_orderkey AS VARCHAR(20))) AS id,
       'aprobada' AS estado, '2024-02-01' AS fecha_decision, 2 AS seq
FROM {orders} WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'
"""

# --- new-client forms (supplier master data; some ids already exist) ----
ADAPTERS["client_forms"] = """
SELECT s_suppkey AS form_id,
       CASE WHEN s_suppkey % 4 = 0 THEN concat(CAST(s_suppkey AS VARCHAR(20)), '.0')
            WHEN s_suppkey % 4 = 1 THEN concat('9', CAST(s_suppkey AS VARCHAR(20)), '-1')
            ELSE concat('8', CAST(s_suppkey AS VARCHAR(20))) END AS identificacion,
       CASE WHEN s_suppkey % 10 = 3 THEN '' ELSE s_name END AS nombres,
       n_name AS apellidos,
       'Calle 1' AS direccion,
       CAST(s_nationkey + 1 AS VARCHAR(20)) AS codigo_departamento,
       CAST((s_nationkey + 1) * 1000 AS VARCHAR(20)) AS codigo_ciudad,
       CASE WHEN s_suppkey % 6 = 5 THEN '12-34' ELSE concat('+57 310 ', CAST(s_suppkey AS VARCHAR(20))) END AS telefono,
       CASE WHEN s_suppkey % 7 = 2 THEN 'sin correo' ELSE concat('s', CAST(s_suppkey AS VARCHAR(20)), '@mail.co') END AS correo
FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey
"""

# --- client ids typed into the movement worklist ------------------------
ADAPTERS["assignment_edits"] = """
SELECT casillero, source_file, id_ingreso,
       CASE WHEN id_cliente IS NULL OR trim(id_cliente) = '' THEN substr(id_ingreso, 12, 3)
            WHEN id_cliente = '999999999' THEN ''
            ELSE id_cliente END AS nuevo_id_cliente
FROM (""" + ADAPTERS["movements"] + """) m
"""

_PLACEHOLDER = re.compile(r"\{(" + "|".join(DRIVER_TABLES) + r")\}")


def tables_of(sql: str) -> list[str]:
    """Driver tables an adapter text reads."""
    return sorted(set(_PLACEHOLDER.findall(sql)))


def bind(sql: str, names: dict[str, str]) -> str:
    """Replace ``{table}`` placeholders (and nothing else) by view names."""
    return _PLACEHOLDER.sub(lambda m: names[m.group(1)], sql)


def oracle_text(name: str) -> str:
    """Adapter text with the plain driver view names (DuckDB)."""
    sql = ADAPTERS[name]
    return bind(sql, {t: t for t in tables_of(sql)})


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def register_tables(spark: SparkSession, sf_dir: str, tables) -> dict[str, str]:
    """Session views over the driver parquet files of one folder.

    The view name carries a hash of the folder, so two folders never clash;
    ``spark.sql`` resolves views at analysis, so a built DataFrame keeps its
    plan even if a view is replaced later.
    """
    tag = hashlib.sha1(sf_dir.rstrip("/").encode()).hexdigest()[:10]
    names = {}
    for t in tables:
        v = f"ll_{t}_{tag}"
        if not spark.catalog.tableExists(v):
            read_table(spark, sf_dir, t).createOrReplaceTempView(v)
        names[t] = v
    return names


def input_bytes(spark: SparkSession, path: str) -> int:
    """Size of a file or folder on any file system Spark knows; nothing is opened."""
    from ledgerloom.sources.sinks import _fs
    fs, p, _ = _fs(spark, path)
    return fs.getContentSummary(p).getLength() if fs.exists(p) else 0


# Domain tables already written to storage: (folder, adapter) -> path.
_STORED: dict[tuple[str, str], str] = {}


def derive(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Run one adapter in Spark over the parquet tables of ``sf_dir``."""
    sql = ADAPTERS[name]
    grow_shuffles(spark, sum(input_bytes(spark, f"{sf_dir.rstrip('/')}/{t}.parquet") for t in tables_of(sql)))
    return spark.sql(bind(sql, register_tables(spark, sf_dir, tables_of(sql))))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A domain table: the stored copy when ``store`` wrote one, else the
    adapter derived on the fly from the driver tables."""
    path = _STORED.get((sf_dir.rstrip("/"), name))
    if path:
        grow_shuffles(spark, input_bytes(spark, path))
        return spark.read.parquet(path)
    return derive(spark, sf_dir, name)


def store(spark: SparkSession, sf_dir: str, names=None, files: int | None = None) -> dict[str, str]:
    """Write adapters as parquet tables (``files`` files each, so scans run
    in parallel) under the shared checkpoint folder, and read them from
    there afterwards.  This is the production shape: operators read stored
    domain tables; the adapters only synthesise them from the driver data.
    """
    from ledgerloom.sources.sinks import scratch_path, tag
    n = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = {}
    for name in names or list(ADAPTERS):
        path = scratch_path(spark, "tables", tag(sf_dir.rstrip("/")), name)
        derive(spark, sf_dir, name).repartition(n).write.mode("overwrite").parquet(path)
        _STORED[(sf_dir.rstrip("/"), name)] = path
        out[name] = path
    return out
