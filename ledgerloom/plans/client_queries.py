"""Client master data and movement assignment queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import clients as C
from ledgerloom.plans.oracle import clean_id, with_views
from ledgerloom.plans.registry import query
from ledgerloom.sources import adapters as A
from ledgerloom.sources import readers

SELLER_ID = "000000000"  # configuration: the seller's identification


def _nz(x: str) -> str:
    return f"(CASE WHEN length({x}) < LEN THEN lpad({x}, LEN, '0') ELSE {x} END)"


CLEAN_BODY = f"""
, c0 AS (SELECT *, coalesce(regexp_replace(trim(CAST(codigo_departamento AS VARCHAR)), '\\.0$', ''), '') AS d0,
                   coalesce(regexp_replace(trim(CAST(codigo_ciudad AS VARCHAR)), '\\.0$', ''), '') AS c0_
         FROM clients),
  c1 AS (SELECT *, {_nz('d0').replace('LEN', '2')} AS d1, {_nz('c0_').replace('LEN', '5')} AS c1_ FROM c0),
  cc AS (SELECT identificacion, nombres, apellidos, direccion,
                CASE WHEN d1 IN ('0', '00') THEN '' ELSE d1 END AS codigo_departamento,
                CASE WHEN c1_ IN ('0', '00000') THEN '' ELSE c1_ END AS codigo_ciudad,
                regexp_replace(trim(CAST(telefono AS VARCHAR)), '\\.0$', '') AS telefono,
                correo, ordinal,
                regexp_replace(trim(coalesce(identificacion, '')), '[ .\\-+]', '', 'g') AS id_norm,
                (identificacion IS NOT NULL AND trim(identificacion) <> '') AS has_id
         FROM c1),
  clean AS (SELECT identificacion, nombres, apellidos, direccion, codigo_departamento, codigo_ciudad, telefono,
                   correo, ordinal, id_norm,
                   CASE WHEN has_id THEN '13' END AS tipo_identificacion,
                   CASE WHEN has_id THEN 'Es persona' END AS tipo,
                   CASE WHEN has_id THEN 'Col' END AS codigo_pais,
                   CASE WHEN has_id THEN '0' END AS tipo_regimen_iva,
                   CASE WHEN has_id THEN 'R-99-PN' END AS codigo_responsabilidad_fiscal,
                   CASE WHEN has_id THEN '{SELLER_ID}' END AS identificacion_vendedor,
                   CASE WHEN has_id THEN 'SI' END AS clientes,
                   CASE WHEN has_id THEN 'Activo' END AS estado,
                   CASE WHEN has_id THEN nombres END AS nombres_contacto,
                   CASE WHEN has_id THEN apellidos END AS apellidos_contacto,
                   CASE WHEN has_id THEN telefono END AS telefono_contacto
            FROM cc)
"""


def _clients(spark, sf):
    return C.clients_clean(A.load(spark, sf, "clients"), seller_id=SELLER_ID)


@query("clients_clean", with_views(["clients"], CLEAN_BODY + "SELECT * FROM clean"))
def q_clients_clean(spark, sf):
    return _clients(spark, sf)


@query("client_lookup", with_views(["clients", "movements"], CLEAN_BODY + """
, p AS (SELECT DISTINCT id_cliente AS probe FROM movements WHERE id_cliente IS NOT NULL AND trim(id_cliente) <> '')
SELECT DISTINCT p.probe, c.* FROM p JOIN clean c ON trim(p.probe) = trim(c.identificacion)
UNION
SELECT DISTINCT p.probe, c.* FROM p JOIN clean c
  ON regexp_replace(trim(p.probe), '[ .\\-+]', '', 'g') = trim(c.id_norm)"""))
def q_client_lookup(spark, sf):
    probes = A.load(spark, sf, "movements").select(F.col("id_cliente").alias("probe"))
    return C.client_lookup(_clients(spark, sf), probes)


VALIDATION_BODY = """
, f AS (SELECT *,
               (identificacion IS NULL OR trim(identificacion) = '' OR nombres IS NULL OR trim(nombres) = ''
                OR apellidos IS NULL OR trim(apellidos) = '' OR direccion IS NULL OR trim(direccion) = ''
                OR codigo_departamento IS NULL OR trim(codigo_departamento) = ''
                OR codigo_ciudad IS NULL OR trim(codigo_ciudad) = '' OR telefono IS NULL OR trim(telefono) = ''
                OR correo IS NULL OR trim(correo) = '') AS missing,
               regexp_matches(trim(correo), '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$') AS email_ok,
               regexp_matches(regexp_replace(coalesce(telefono, ''), '[^0-9]', '', 'g'), '^[0-9]{6,20}$') AS phone_ok,
               EXISTS (SELECT 1 FROM clean c WHERE trim(c.identificacion) = trim(client_forms.identificacion))
               OR EXISTS (SELECT 1 FROM clean c WHERE trim(c.id_norm) =
                          regexp_replace(trim(coalesce(client_forms.identificacion, '')), '[ .\\-+]', '', 'g')) AS dup
        FROM client_forms),
  judged AS (SELECT * EXCLUDE (missing, email_ok, phone_ok, dup),
            CASE WHEN missing THEN 'missing_fields' WHEN NOT email_ok THEN 'bad_email'
            WHEN NOT phone_ok THEN 'bad_phone' WHEN dup THEN 'duplicate_id' END AS reason
             FROM f)
"""


@query("client_validation", with_views(["clients", "client_forms"], CLEAN_BODY + VALIDATION_BODY + "SELECT * FROM judged"))
def q_client_validation(spark, sf):
    return C.client_validation(A.load(spark, sf, "client_forms"), _clients(spark, sf))


# Every form once more in the same batch, later and under another name.
AGAIN = 1_000_000


@query("clients_append", with_views(["clients", "client_forms"], f"""
, forms2 AS (SELECT * FROM client_forms UNION ALL SELECT * REPLACE (form_id + {AGAIN} AS form_id, 'Otro' AS nombres) FROM client_forms)
""" + CLEAN_BODY + VALIDATION_BODY.replace("client_forms", "forms2") + """
, added AS (SELECT trim(identificacion) AS identificacion, trim(nombres) AS nombres, trim(apellidos) AS apellidos,
                   trim(direccion) AS direccion, lpad(trim(codigo_departamento), 2, '0') AS codigo_departamento,
                   CASE WHEN length(trim(codigo_ciudad)) < 5 THEN lpad(trim(codigo_ciudad), 5, '0') ELSE trim(codigo_ciudad) END
                     AS codigo_ciudad,
                   regexp_replace(telefono, '[^0-9]', '', 'g') AS telefono, trim(correo) AS correo
            FROM judged WHERE reason IS NULL
            QUALIFY row_number() OVER (PARTITION BY regexp_replace(trim(identificacion), '[ .\\-+]', '', 'g') ORDER BY form_id) = 1)
SELECT * FROM clean
UNION ALL BY NAME
SELECT *, regexp_replace(identificacion, '[ .\\-+]', '', 'g') AS id_norm, '13' AS tipo_identificacion, 'Es persona' AS tipo,
       'Col' AS codigo_pais, '0' AS tipo_regimen_iva, 'R-99-PN' AS codigo_responsabilidad_fiscal,
       '""" + SELLER_ID + """' AS identificacion_vendedor, 'SI' AS clientes, 'Activo' AS estado, nombres AS nombres_contacto,
       apellidos AS apellidos_contacto, telefono AS telefono_contacto
FROM added"""))
def q_clients_append(spark, sf):
    forms = A.load(spark, sf, "client_forms")
    twice = forms.union(forms.withColumns({"form_id": F.col("form_id") + AGAIN, "nombres": F.lit("Otro")}))
    return C.append_clients(A.load(spark, sf, "clients"), twice, SELLER_ID)


SYSDATE_SQL = """(CASE WHEN try_strptime(lpad_digits, '%d%m%Y') IS NOT NULL
                   AND year(try_strptime(lpad_digits, '%d%m%Y')) BETWEEN 1677 AND 2262
              THEN strftime(try_strptime(lpad_digits, '%d%m%Y'), '%d-%m-%Y') ELSE trim(fecha_sistema) END)"""
DIGITS8 = """(CASE WHEN length(regexp_replace(coalesce(trim(fecha_sistema), ''), '[^0-9]', '', 'g')) < 8
                   THEN lpad(regexp_replace(coalesce(trim(fecha_sistema), ''), '[^0-9]', '', 'g'), 8, '0')
                   ELSE regexp_replace(coalesce(trim(fecha_sistema), ''), '[^0-9]', '', 'g') END)"""
NORMALISED = SYSDATE_SQL.replace("lpad_digits", DIGITS8)


@query("sysdate_normalise", with_views(["movements"], f"""
SELECT casillero, id_ingreso, {NORMALISED} AS fecha_sistema FROM movements"""))
def q_sysdate_normalise(spark, sf):
    mv = A.load(spark, sf, "movements").select("casillero", "id_ingreso",
                                               F.col("fecha_sistema").alias("Fecha  del Sistema"))
    return readers.normalise_sysdate(mv, file_col=None)


WORKLIST_BODY = f"""
, wl AS (SELECT casillero, source_file, id_ingreso, id_cliente, factura,
                CASE WHEN s IS NULL OR lower(trim(s)) IN ('', 'nan', 'none', 'null', 'na') THEN substr(id_ingreso, 1, 10)
                     ELSE s END AS fecha_sistema,
                referencia, monto
         FROM (SELECT *, {NORMALISED} AS s FROM movements)
         WHERE NOT coalesce(monto < 0, false)
           AND NOT coalesce(upper(trim(referencia)) = 'ABONO INTERESES AHORROS', false))
"""


@query("movement_worklist", with_views(["movements"], WORKLIST_BODY + "SELECT * FROM wl"))
def q_movement_worklist(spark, sf):
    return C.movement_worklist(A.load(spark, sf, "movements"))


CHANGED_BODY = f"""
, ch AS (SELECT e.casillero, e.source_file, e.id_ingreso, trim(coalesce(e.nuevo_id_cliente, '')) AS new_id
         FROM assignment_edits e JOIN movements m
           ON e.casillero = m.casillero AND e.source_file = m.source_file AND e.id_ingreso = m.id_ingreso
         WHERE {clean_id('m.id_cliente')} IS DISTINCT FROM trim(coalesce(e.nuevo_id_cliente, ''))),
  missing AS (SELECT DISTINCT casillero, source_file, new_id AS id_cliente FROM ch
              WHERE new_id <> '' AND new_id NOT IN (SELECT trim(identificacion) FROM clients
                                                    WHERE identificacion IS NOT NULL))
"""


@query("assignment_check", with_views(["movements", "assignment_edits", "clients"], CHANGED_BODY +
                                      "SELECT * FROM missing"))
def q_assignment_check(spark, sf):
    return C.assignment_check(A.load(spark, sf, "movements"), A.load(spark, sf, "assignment_edits"),
                              A.load(spark, sf, "clients"))


@query("assignment_apply", with_views(["movements", "assignment_edits", "clients"], CHANGED_BODY + """
, ok AS (SELECT * FROM ch WHERE NOT EXISTS (SELECT 1 FROM missing b WHERE b.casillero = ch.casillero
                                            AND b.source_file = ch.source_file))
SELECT m.* REPLACE (CASE WHEN ok.new_id IS NOT NULL THEN ok.new_id ELSE m.id_cliente END AS id_cliente),
       ok.new_id IS NOT NULL AS applied
FROM movements m LEFT JOIN ok ON m.casillero = ok.casillero AND m.source_file = ok.source_file
                              AND m.id_ingreso = ok.id_ingreso"""))
def q_assignment_apply(spark, sf):
    return C.assignment_apply(A.load(spark, sf, "movements"), A.load(spark, sf, "assignment_edits"),
                              A.load(spark, sf, "clients"))
