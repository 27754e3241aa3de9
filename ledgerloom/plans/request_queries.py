"""Request, withdrawal and receipt-list queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ledgerloom import schemas
from ledgerloom.operators import requests as R
from ledgerloom.plans.oracle import with_views
from ledgerloom.plans.registry import query
from ledgerloom.sources import adapters as A
from ledgerloom.sources import readers, sinks
from ledgerloom.sources.versioned import VersionedTable

TODAY = "2024-01-31"  # "today" of the form entries is a parameter, not now()

RECEIPT_TYPE = ('[{"ruta":"VARCHAR","banco":"VARCHAR","monto":"VARCHAR","fecha":"VARCHAR",'
                '"cuenta":"VARCHAR","referencia":"VARCHAR"}]')
PARSED = f"""
, p AS (SELECT *, CASE WHEN json_valid(trim(comprobantes)) AND json_type(trim(comprobantes)) = 'ARRAY'
                       THEN from_json(trim(comprobantes), '{RECEIPT_TYPE}') ELSE [] END AS rs
        FROM requests)
"""


def money(x: str) -> str:
    return f"(CASE WHEN isfinite(try_cast({x} AS DOUBLE)) THEN CAST(try_cast({x} AS DOUBLE) AS DECIMAL(18,2)) END)"


def trailing(x: str) -> str:
    return f"try_cast(nullif(regexp_extract(coalesce({x}, ''), '(\\d+)\\s*$', 1), '') AS BIGINT)"


def _requests(spark, sf):
    return readers.load_requests(A.load(spark, sf, "requests"))


REQUEST_COLUMNS = """casillero, id, descripcion, monto, fecha, numero_cuenta, tipo, estado,
       CAST(NULL AS VARCHAR) AS fecha_creacion, CAST(NULL AS VARCHAR) AS fecha_realizado,
       CAST(NULL AS VARCHAR) AS fecha_decision, comprobantes, CAST(NULL AS DECIMAL(18,2)) AS monto_abonado,
       mayorista_retira, comision_pct, id_retiro, egreso_retiro"""


@query("requests_load", with_views(["requests"], f"SELECT {REQUEST_COLUMNS} FROM requests"))
def q_requests_load(spark, sf):
    return _requests(spark, sf)


@query("receipts_explode", with_views(["requests"], PARSED + f"""
SELECT casillero, id, estado, CAST(u.i AS BIGINT) AS n, u.r.ruta AS ruta, u.r.banco AS banco,
       CAST({money('u.r.monto')} AS DECIMAL(38,2)) AS monto, u.r.fecha AS fecha, u.r.cuenta AS cuenta,
       u.r.referencia AS referencia,
       concat_ws('_', regexp_replace(id, '[^A-Za-z0-9._-]', '_', 'g'), CAST(u.i AS VARCHAR)) AS file_name
FROM p, unnest(p.rs) WITH ORDINALITY AS u(r, i)"""))
def q_receipts_explode(spark, sf):
    return R.receipts_explode(_requests(spark, sf))


@query("request_balance", with_views(["requests"], PARSED + f"""
, b AS (SELECT casillero, id, estado, CAST(coalesce({money('monto')}, 0) AS DECIMAL(38,2)) AS monto,
               CAST((SELECT coalesce(sum(coalesce({money('x.monto')}, 0)), 0) FROM unnest(p.rs) AS t(x))
                    AS DECIMAL(38,2)) AS paid,
               CAST(len(rs) AS BIGINT) AS n_receipts
        FROM p WHERE lower(trim(estado)) IN ('parcial', 'en revision'))
SELECT casillero, id, estado, monto, paid,
       CAST(greatest(monto - paid, 0) AS DECIMAL(38,2)) AS missing, n_receipts
FROM b"""))
def q_request_balance(spark, sf):
    return R.request_balance(_requests(spark, sf))


@query("withdrawals", with_views(["requests", "accounts"], f"""
, w AS (SELECT trim(mayorista_retira) AS retira, casillero AS recibe, id, id_retiro, descripcion,
               CAST({money('monto')} AS DECIMAL(38,2)) AS monto, comision_pct,
               CAST({money('egreso_retiro')} AS DECIMAL(38,2)) AS egreso_retiro, estado
        FROM requests
        WHERE mayorista_retira IS NOT NULL AND lower(trim(mayorista_retira)) NOT IN ('', 'nan', 'none', 'null', '<na>')),
  s AS (SELECT retira,
               CAST(sum(CASE WHEN lower(trim(estado)) = 'aprobada' THEN coalesce(egreso_retiro, 0) ELSE 0 END)
                    AS DECIMAL(38,2)) AS egreso_confirmado,
               CAST(sum(CASE WHEN lower(trim(estado)) IN ('pendiente', 'parcial', 'en revision')
                        THEN coalesce(egreso_retiro, 0) ELSE 0 END) AS DECIMAL(38,2)) AS egreso_pendiente
        FROM w GROUP BY retira),
  n AS (SELECT code, coalesce(override, name) AS display FROM accounts)
SELECT w.*, s.egreso_confirmado, s.egreso_pendiente, na.display AS retira_name, nb.display AS recibe_name
FROM w JOIN s ON w.retira = s.retira
LEFT JOIN n na ON w.retira = na.code LEFT JOIN n nb ON w.recibe = nb.code"""))
def q_withdrawals(spark, sf):
    return R.withdrawals(_requests(spark, sf), A.load(spark, sf, "accounts"))


NEXT_IDS_BODY = f"""
, rq AS (SELECT casillero, max({trailing('id')}) AS mx FROM requests GROUP BY casillero),
  wd AS (SELECT trim(mayorista_retira) AS casillero, max({trailing('id_retiro')}) AS mx FROM requests
         WHERE mayorista_retira IS NOT NULL AND lower(trim(mayorista_retira)) NOT IN ('', 'nan', 'none', 'null', '<na>')
         GROUP BY trim(mayorista_retira)),
  nx AS (SELECT coalesce(rq.casillero, wd.casillero) AS casillero,
                coalesce(rq.mx, 0) + 1 AS req0, coalesce(wd.mx, 0) + 1 AS wd0
         FROM rq FULL OUTER JOIN wd ON rq.casillero = wd.casillero)
"""


@query("next_ids", with_views(["requests"], NEXT_IDS_BODY + """
SELECT casillero, concat('Consignacion', CAST(req0 AS VARCHAR)) AS next_request_id,
       concat('retiro', CAST(wd0 AS VARCHAR)) AS next_withdrawal_id FROM nx"""))
def q_next_ids(spark, sf):
    return R.next_ids(_requests(spark, sf))


FORMS_BODY = """
, fv AS (SELECT *,
                (mayorista_retira IS NOT NULL AND lower(trim(mayorista_retira)) NOT IN ('', 'nan', 'none', 'null', '<na>')) AS wd
         FROM request_forms),
  f AS (SELECT * EXCLUDE (wd), wd,
               CASE WHEN wd AND trim(mayorista_retira) = casillero THEN 'same_account'
                    WHEN wd AND (monto IS NULL OR monto = 0 OR numero_cuenta IS NULL OR trim(numero_cuenta) = '')
                         THEN 'missing_amount_or_account'
                    WHEN NOT wd AND (descripcion IS NULL OR trim(descripcion) = '' OR monto IS NULL OR monto = 0
                                     OR numero_cuenta IS NULL OR trim(numero_cuenta) = '') THEN 'missing_fields'
               END AS reason
        FROM fv)
"""


@query("requests_validation", with_views(["request_forms"], FORMS_BODY + """
SELECT * EXCLUDE (wd) FROM f"""))
def q_requests_validation(spark, sf):
    return R.validate_forms(A.load(spark, sf, "request_forms"))


NEW_ROWS_BODY = NEXT_IDS_BODY + FORMS_BODY + """
, ok AS (SELECT * FROM f WHERE reason IS NULL),
  rk AS (SELECT ok.*,
                row_number() OVER (PARTITION BY casillero ORDER BY form_id, descripcion, monto, numero_cuenta,
                                   mayorista_retira NULLS FIRST) AS rq,
                row_number() OVER (PARTITION BY wd, trim(mayorista_retira) ORDER BY form_id, descripcion, monto,
                                   numero_cuenta, mayorista_retira NULLS FIRST) AS rw
         FROM ok),
  new AS (SELECT rk.casillero,
                 concat('Consignacion', CAST(coalesce(b.req0, 1) + rq - 1 AS VARCHAR)) AS id,
                 CASE WHEN NOT wd THEN trim(descripcion)
                      WHEN trim(descripcion) = '' THEN 'Retiro de ' || coalesce(an.override, an.name, trim(mayorista_retira))
                      ELSE 'Retiro de ' || coalesce(an.override, an.name, trim(mayorista_retira)) || ' — ' || trim(descripcion)
                 END AS descripcion, CAST(monto AS DECIMAL(18,2)) AS monto,
                 CASE WHEN wd OR fecha IS NULL THEN '2024-01-31' ELSE fecha END AS fecha, trim(numero_cuenta) AS numero_cuenta,
                 CASE WHEN wd THEN 'Retiro' ELSE tipo END AS tipo, 'pendiente' AS estado,
                 '2024-01-31' AS fecha_creacion, '' AS fecha_realizado, '' AS fecha_decision,
                 '[]' AS comprobantes, CAST(0 AS DECIMAL(18,2)) AS monto_abonado,
                 CASE WHEN wd THEN trim(mayorista_retira) END AS mayorista_retira,
                 CASE WHEN wd THEN comision_pct END AS comision_pct,
                 CASE WHEN wd THEN concat('retiro', CAST(coalesce(a.wd0, 1) + rw - 1 AS VARCHAR)) END AS id_retiro,
                 CASE WHEN wd THEN CAST(CAST(monto AS DECIMAL(18,2)) * (100 + CAST(coalesce(comision_pct, 0) AS DECIMAL(9,4)))
                                        * 0.01 AS DECIMAL(18,2)) END AS egreso_retiro
          FROM rk LEFT JOIN nx b ON rk.casillero = b.casillero
          LEFT JOIN nx a ON trim(rk.mayorista_retira) = a.casillero
          LEFT JOIN accounts an ON trim(rk.mayorista_retira) = an.code)
"""


@query("requests_append", with_views(["requests", "request_forms", "accounts"], NEW_ROWS_BODY + f"""
SELECT {REQUEST_COLUMNS} FROM requests
UNION ALL
SELECT * FROM new"""))
def q_requests_append(spark, sf):
    return R.append_forms(_requests(spark, sf), A.load(spark, sf, "request_forms"), TODAY, A.load(spark, sf, "accounts"))


@query("withdrawals_append", with_views(["requests", "request_forms", "accounts"], NEW_ROWS_BODY + """
SELECT casillero, id, descripcion, mayorista_retira, monto, comision_pct, id_retiro, egreso_retiro FROM new
WHERE mayorista_retira IS NOT NULL"""))
def q_withdrawals_append(spark, sf):
    new = R.new_request_rows(_requests(spark, sf), A.load(spark, sf, "request_forms"), TODAY, A.load(spark, sf, "accounts"))
    return new.filter(F.col("mayorista_retira").isNotNull()).select(
        "casillero", "id", "descripcion", "mayorista_retira", "monto", "comision_pct", "id_retiro", "egreso_retiro")


@query("requests_upsert", with_views(["requests", "decisions"], f"""
, last AS (SELECT casillero, id, arg_max(estado, seq) AS estado, arg_max(fecha_decision, seq) AS fecha_decision
           FROM decisions GROUP BY casillero, id),
  r AS (SELECT {REQUEST_COLUMNS} FROM requests)
SELECT r.* REPLACE (coalesce(l.estado, r.estado) AS estado, coalesce(l.fecha_decision, r.fecha_decision) AS fecha_decision)
FROM r LEFT JOIN last l ON r.casillero = l.casillero AND r.id = l.id"""))
def q_requests_upsert(spark, sf):
    return R.upsert_by_id(_requests(spark, sf), A.load(spark, sf, "decisions"))


@query("requests_merge", with_views(["requests", "decisions"], f"""
, ranked AS (SELECT *, row_number() OVER (PARTITION BY casillero, id ORDER BY seq DESC) AS n FROM decisions),
  r AS (SELECT {REQUEST_COLUMNS} FROM requests)
SELECT r.* REPLACE (coalesce(d.estado, r.estado) AS estado, coalesce(d.fecha_decision, r.fecha_decision) AS fecha_decision)
FROM r LEFT JOIN ranked d ON r.casillero = d.casillero AND r.id = d.id AND d.n = 1"""))
def q_requests_merge(spark, sf):
    """The stored table after its decisions, merged bucket by bucket."""
    root = f"{sinks.scratch_path(spark, 'merge', sinks.tag(sf))}-{uuid.uuid4().hex}"
    stored = VersionedTable(spark, root, schemas.REQUESTS)
    stored.create(_requests(spark, sf))
    stored.merge(A.load(spark, sf, "decisions"), R.upsert_by_id)
    return stored.read()


@query("json_lenient", with_views(["model_replies"], """
, t AS (SELECT event_id, trim(regexp_replace(trim(reply), '(?i)^```(?:json)?\\s*|\\s*```$', '', 'g')) AS t FROM model_replies),
  j AS (SELECT event_id, CASE WHEN json_valid(t) THEN t WHEN json_valid(regexp_extract(t, '(?s)\\{.*\\}', 0)) THEN regexp_extract(t, '(?s)\\{.*\\}', 0) END AS js FROM t)
SELECT event_id, js IS NOT NULL AS readable, try_cast(json_extract_string(js, '$.k') AS BIGINT) AS k FROM j"""))
def q_json_lenient(spark, sf):
    from ledgerloom.functions.jsontext import lenient_json
    df = A.load(spark, sf, "model_replies").withColumn("js", lenient_json("reply"))
    return df.select("event_id", F.col("js").isNotNull().alias("readable"),
                     F.get_json_object("js", "$.k").try_cast("bigint").alias("k"))
