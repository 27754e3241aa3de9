"""Billing queries: one batch run, read through its output tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ledgerloom.operators import billing as B
from ledgerloom.operators.sequence import materialise
from ledgerloom.plans.oracle import clean_id, clean_text, digits, with_views, zfill
from ledgerloom.plans.registry import query
from ledgerloom.sources import adapters as A
from ledgerloom.sources import sinks
from ledgerloom.sources.versioned import VersionedTable

# Configuration of the run (invented provider ids; dates are parameters).
CONFIG = B.BillingConfig(doc_id=1, seller_id=2, payment_id=3, vat_tax_id=4, third_party_id="000000001",
                         as_of="2024-01-31")
KEY = "casillero, source_file, id_ingreso"


def _run(spark, sf):
    mv = A.load(spark, sf, "movements")
    reserved = (mv.select(F.trim("factura").try_cast("bigint").alias("number"))
                .filter(F.col("number").isNotNull()))
    return B.billing_run(mv, A.load(spark, sf, "clients"), A.load(spark, sf, "known_customers"),
                         A.load(spark, sf, "notes"), A.load(spark, sf, "invoice_register"), CONFIG,
                         reserved=reserved)


def _money(x: str) -> str:
    return f"CAST(CAST({x} AS DECIMAL(38,0)) * 0.01 AS DECIMAL(38,2))"


NOMBRES0 = clean_text("c.nombres")
APELLIDOS0 = clean_text("c.apellidos")
TOKENS = f"list_filter(string_split_regex(trim({NOMBRES0}), '\\s+'), lambda x: x <> '')"

BILLING_BODY = f"""
, pend AS (SELECT m.* REPLACE ({clean_id('m.id_cliente')} AS id_cliente) FROM movements m
           WHERE {clean_id('m.id_cliente')} <> '' AND (m.factura IS NULL OR trim(m.factura) = '')),
  cidx AS (SELECT * EXCLUDE (rn) FROM (
             SELECT c.*, {clean_id('c.identificacion')} AS cid,
                    row_number() OVER (PARTITION BY {clean_id('c.identificacion')} ORDER BY c.ordinal DESC) AS rn
             FROM clients c) WHERE rn = 1 AND cid <> ''),
  matched AS (SELECT p.*, c.identificacion AS cli_identificacion, c.nombres AS cli_nombres,
                     c.apellidos AS cli_apellidos, c.correo AS cli_correo
              FROM pend p JOIN cidx c ON p.id_cliente = c.cid),
  rej_match AS (SELECT {KEY}, 'match' AS stage, 'client_not_found' AS reason FROM pend p
                WHERE NOT EXISTS (SELECT 1 FROM cidx c WHERE c.cid = p.id_cliente)),
  cf AS (SELECT c.cid AS id_cliente, {clean_id('c.identificacion')} AS ident,
                {NOMBRES0} AS n0, {APELLIDOS0} AS a0, {TOKENS} AS toks,
                {digits(clean_text('c.telefono'))} AS phone, {clean_text('c.correo')} AS email,
                {zfill(digits(clean_text('c.codigo_departamento')), 2)} AS state_code,
                {zfill(digits(clean_text('c.codigo_ciudad')), 5)} AS city_code,
                CASE WHEN {clean_text('c.direccion')} = '' THEN 'No especificado' ELSE {clean_text('c.direccion')} END
                  AS address
         FROM cidx c
         WHERE c.cid IN (SELECT id_cliente FROM matched)
           AND c.cid NOT IN (SELECT {clean_id('identificacion')} FROM known_customers)),
  cf2 AS (SELECT *,
                 CASE WHEN a0 = '' AND len(toks) >= 2 THEN array_to_string(toks[1:len(toks) - 1], ' ')
                      WHEN a0 = '' AND len(toks) = 1 THEN toks[1] ELSE n0 END AS first_name,
                 CASE WHEN a0 = '' AND len(toks) >= 2 THEN toks[len(toks)]
                      WHEN a0 = '' AND len(toks) = 1 THEN toks[1] ELSE a0 END AS last_name
          FROM cf),
  cust AS (SELECT id_cliente,
                  CASE WHEN ident = '' THEN 'empty_id' WHEN first_name = '' THEN 'empty_names'
                       WHEN last_name = '' THEN 'empty_surnames' WHEN phone = '' THEN 'empty_phone'
                       WHEN email = '' THEN 'empty_email'
                       WHEN state_code IN ('00', '0') OR city_code IN ('00000', '0') THEN 'invalid_code' END AS reason,
                  json_object('type', 'Customer', 'person_type', 'Person', 'id_type', '13', 'identification', ident,
                              'name', json_array(first_name, last_name),
                              'address', json_object('address', address,
                                                     'city', json_object('country_code', 'CO', 'state_code', state_code,
                                                                         'city_code', city_code)),
                              'phones', json_array(json_object('number', phone)),
                              'contacts', json_array(json_object('first_name', first_name, 'last_name', last_name,
                                                                 'email', email))) AS js
           FROM cf2),
  customers AS (SELECT id_cliente, reason, CASE WHEN reason IS NULL THEN CAST(js AS VARCHAR) END AS payload FROM cust),
  m1 AS (SELECT m.*, c.reason AS creason FROM matched m LEFT JOIN customers c
           ON m.id_cliente = c.id_cliente AND c.reason IS NOT NULL),
  rej_cust AS (SELECT {KEY}, 'customer' AS stage, creason AS reason FROM m1 WHERE creason IS NOT NULL),
  m2 AS (SELECT m1.* EXCLUDE (creason), n.text AS note FROM m1 LEFT JOIN notes n ON m1.casillero = n.code
         WHERE creason IS NULL),
  rej_note AS (SELECT {KEY}, 'invoice' AS stage, 'no_note' AS reason FROM m2 WHERE note IS NULL),
  sp AS (SELECT *, CAST(round(coalesce(CASE WHEN isfinite(CAST(monto AS DOUBLE)) THEN CAST(monto AS DOUBLE) END, 0) * 100)
                        AS BIGINT) AS cents
         FROM m2 WHERE note IS NOT NULL),
  sp2 AS (SELECT *, CASE WHEN cents > 0 THEN (cents * 2000 + 1015) // 2030 ELSE 0 END AS g,
                    CASE WHEN cents > 0 THEN (cents * 3000 + 120785) // 241570 ELSE 0 END AS s,
                    CASE WHEN cents > 0 THEN (cents * 570 + 120785) // 241570 ELSE 0 END AS v
          FROM sp),
  rej_zero AS (SELECT {KEY}, 'invoice' AS stage, 'zero_total' AS reason FROM sp2 WHERE cents <= 0),
  valid AS (SELECT *, row_number() OVER (ORDER BY casillero, source_file, id_ingreso) AS k FROM sp2 WHERE cents > 0),
  st AS (SELECT coalesce(max(try_cast(trim(CASE WHEN consecutive IS NULL OR trim(consecutive) = '' THEN number
                                                 ELSE consecutive END) AS BIGINT)), 0) + 1 AS start
         FROM invoice_register),
  reserved AS (SELECT DISTINCT try_cast(trim(factura) AS BIGINT) AS number FROM movements
               WHERE try_cast(trim(factura) AS BIGINT) IS NOT NULL),
  free AS (SELECT number, row_number() OVER (ORDER BY number) AS k
           FROM (SELECT t.range AS number FROM range(1, 250000) t) r
           WHERE number >= (SELECT start FROM st) AND number NOT IN (SELECT number FROM reserved)),
  inv AS (SELECT v1.*, f.number FROM valid v1 JOIN free f ON v1.k = f.k),
  rej_limit AS (SELECT {KEY}, 'number' AS stage, 'limit_reached' AS reason FROM valid
                WHERE k > (SELECT count(*) FROM free)),
  invoices AS (SELECT casillero, source_file, id_ingreso, id_cliente, number,
                      CAST(CAST(monto AS DOUBLE) AS DECIMAL(38,2)) AS total_charged,
                      {_money('g')} AS gn1, {_money('s')} AS sr02, {_money('v')} AS iva, {_money('g + s + v')} AS invoice_total,
                      note,
                      CAST(json_object('document', json_object('id', 1), 'date', '2024-01-31', 'number', number,
                        'customer', json_object('identification', id_cliente),
                        'stamp', json_object('send', false), 'mail', json_object('send', false), 'seller', 2,
                        'items', json_array(
                           json_object('code', 'GN1', 'quantity', 1, 'price', CAST({_money('g')} AS DOUBLE),
                                       'taxes', json_array(), 'customer', json_object('identification', '000000001')),
                           json_object('code', 'SR02', 'quantity', 1, 'price', CAST({_money('s')} AS DOUBLE),
                                       'taxes', json_array(json_object('id', 4)))),
                        'payments', json_array(json_object('id', 3, 'value', CAST({_money('g + s + v')} AS DOUBLE),
                                                           'due_date', '2024-01-31')),
                        'observations', note, 'additional_fields', json_object()) AS VARCHAR) AS payload
               FROM inv),
  rejects AS (SELECT * FROM rej_match UNION ALL SELECT * FROM rej_cust UNION ALL SELECT * FROM rej_note
              UNION ALL SELECT * FROM rej_zero UNION ALL SELECT * FROM rej_limit)
"""
VIEWS = ["movements", "clients", "known_customers", "notes", "invoice_register"]


def billing_sql(select: str, extra_views=()) -> str:
    return with_views(VIEWS + list(extra_views), BILLING_BODY + select)


@query("billing_pending", with_views(["movements"], BILLING_BODY.split("  cidx AS")[0].rstrip().rstrip(",") +
                                     "\nSELECT * FROM pend"))
def q_billing_pending(spark, sf):
    return B.pending(A.load(spark, sf, "movements"))


PREVIEW_ROWS = 50


@query("billing_preview", with_views(["movements"], BILLING_BODY.split("  cidx AS")[0].rstrip().rstrip(",") + f"""
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY casillero ORDER BY source_file, id_ingreso) AS INTEGER) AS place FROM pend)
WHERE place <= {PREVIEW_ROWS}"""))
def q_billing_preview(spark, sf):
    return B.preview(B.pending(A.load(spark, sf, "movements")), PREVIEW_ROWS)


@query("client_match", billing_sql(f"SELECT {KEY}, id_cliente, cli_identificacion, cli_nombres, cli_apellidos, "
                                   "cli_correo FROM matched"))
def q_client_match(spark, sf):
    m, _ = B.match_clients(B.pending(A.load(spark, sf, "movements")), A.load(spark, sf, "clients"))
    return m.select(*B.MOVEMENT_KEY, "id_cliente", "cli_identificacion", "cli_nombres", "cli_apellidos",
                    "cli_correo")


@query("customer_payload", billing_sql("SELECT * FROM customers"))
def q_customer_payload(spark, sf):
    return _run(spark, sf).new_customers


# An unrounded amount in the column of first choice, absent in some rows.
UNROUNDED = "CASE WHEN factura IS NULL THEN NULL ELSE CAST(monto * 1.0037 AS DECIMAL(24,6)) END"


@query("invoice_split", with_views(["movements"], f"""
, sp AS (SELECT {KEY}, coalesce({UNROUNDED}, monto, 0) AS t FROM movements),
  u AS (SELECT *, CAST(t * 1000000 AS HUGEINT) AS u FROM sp),
  sp2 AS (SELECT *, CASE WHEN u > 0 THEN (u * 2000 + 10150000) // 20300000 ELSE 0 END AS g,
                    CASE WHEN u > 0 THEN (u * 3000 + 1207850000) // 2415700000 ELSE 0 END AS s,
                    CASE WHEN u > 0 THEN (u * 570 + 1207850000) // 2415700000 ELSE 0 END AS v FROM u)
SELECT {KEY}, CAST(t AS DECIMAL(38,2)) AS total_charged,
       {_money('g')} AS gn1, {_money('s')} AS sr02, {_money('v')} AS iva, {_money('g + s + v')} AS invoice_total,
       round(t, 2) <= 0 AS zero_total
FROM sp2"""))
def q_invoice_split(spark, sf):
    mv = A.load(spark, sf, "movements").withColumn("monto_cop_compact", F.expr(UNROUNDED))
    return B.with_split(mv).select(
        *B.MOVEMENT_KEY, "total_charged", "gn1", "sr02", "iva", "invoice_total", "zero_total")


@query("invoice_numbers", billing_sql(f"SELECT {KEY}, number FROM invoices"))
def q_invoice_numbers(spark, sf):
    return _run(spark, sf).invoices.select(*B.MOVEMENT_KEY, "number")


@query("register_max", with_views(["invoice_register"], """
SELECT max(coalesce(try_cast(nullif(trim(consecutive), '') AS BIGINT), CASE WHEN coalesce(trim(consecutive), '') = '' THEN try_cast(trim(number) AS BIGINT) END))
       AS last_number FROM invoice_register"""))
def q_register_max(spark, sf):
    """The maximum of the stored register, from its files' statistics."""
    path = f"{sinks.scratch_path(spark, 'register', sinks.tag(sf))}-{uuid.uuid4().hex}"
    B.register_numbers(A.load(spark, sf, "invoice_register")).write.parquet(path)
    return B.stored_register_max(spark, path)


@query("invoice_payload", billing_sql(f"SELECT {KEY}, number, payload FROM invoices"))
def q_invoice_payload(spark, sf):
    return _run(spark, sf).invoices.select(*B.MOVEMENT_KEY, "number", "payload")


@query("billing_run", billing_sql("SELECT * FROM invoices"))
def q_billing_run(spark, sf):
    return _run(spark, sf).invoices


@query("billing_rejects", billing_sql("SELECT * FROM rejects"))
def q_billing_rejects(spark, sf):
    return _run(spark, sf).rejects


@query("reject_log_append", billing_sql("SELECT * FROM rejects"))
def q_reject_log_append(spark, sf):
    """The log after two batches, each run twice, as a restarted job does."""
    rejects = _run(spark, sf).rejects
    root = f"{sinks.scratch_path(spark, 'reject-log', sinks.tag(sf))}-{uuid.uuid4().hex}"
    log = VersionedTable(spark, root, rejects.schema)
    for batch, stage in ((1, F.col("stage") == "match"), (2, F.col("stage") != "match")):
        for _ in range(2):
            log.append_once(rejects.filter(stage), "billing", batch)
    return log.read()


@query("billing_summary", billing_sql("""
, tagged AS (SELECT casillero, 'read' AS k FROM movements UNION ALL SELECT casillero, 'pending' FROM pend
             UNION ALL SELECT casillero, 'issued' FROM invoices UNION ALL SELECT casillero, 'failed' FROM rejects)
SELECT casillero, count(*) FILTER (WHERE k = 'read') AS n_read, count(*) FILTER (WHERE k = 'pending') AS n_pending,
       count(*) FILTER (WHERE k = 'issued') AS n_issued, count(*) FILTER (WHERE k = 'failed') AS n_failed
FROM tagged GROUP BY casillero"""))
def q_billing_summary(spark, sf):
    return _run(spark, sf).summary


@query("invoice_writeback", billing_sql("""
, nums AS (SELECT casillero AS a, trim(id_ingreso) AS k, CAST(max(CAST(number AS BIGINT)) AS VARCHAR) AS num FROM invoices GROUP BY ALL)
SELECT m.* REPLACE (coalesce(n.num, m.factura) AS factura) FROM movements m LEFT JOIN nums n ON m.casillero = n.a AND trim(m.id_ingreso) = n.k"""))
def q_invoice_writeback(spark, sf):
    run = _run(spark, sf)
    return B.writeback(run.movements, run.invoices)


# One round a step of the recursion; the working table holds the rows still open, the numbers that rejects gave up
# ('spare', 'error') and what the round settled. ``top`` is the last place in the list of free numbers handed out.
RETRY = f"""
, tries(casillero, source_file, id_ingreso, k, value, attempts, corrected, step, category, number, top, round) AS (
  SELECT {KEY}, k, {_money('g + s + v')}, 0, false, 'again', '', CAST(NULL AS BIGINT), count(*) OVER (), 0 FROM valid
  UNION ALL
  (WITH avail AS (SELECT k, row_number() OVER (ORDER BY k) AS j FROM tries WHERE step IN ('spare', 'error')),
        refused AS (SELECT *, row_number() OVER (ORDER BY k) AS j FROM tries WHERE step = 'renumber'),
        n AS (SELECT (SELECT count(*) FROM refused) AS r, (SELECT count(*) FROM avail) AS a),
        placed AS (
          SELECT {KEY}, coalesce(a.k, top + r.j - n.a) AS k, value, attempts, corrected, top + greatest(0, n.r - n.a) AS top, round
          FROM refused r LEFT JOIN avail a ON r.j = a.j, n
          UNION ALL SELECT {KEY}, k, value, attempts, corrected, top + greatest(0, n.r - n.a), round FROM tries, n WHERE step IN ('again', 'correct')),
        asked AS (
          SELECT p.* EXCLUDE (k), p.k, f.number,
                 CASE WHEN t.number IS NOT NULL THEN 'The number already exists' ELSE coalesce(e.reply, o.reply, 'ok') END AS reply
          FROM placed p LEFT JOIN free f ON p.k = f.k LEFT JOIN provider_numbers t ON f.number = t.number
               LEFT JOIN provider_replies e ON p.id_ingreso = e.id_ingreso AND e.attempt = 0
               LEFT JOIN provider_replies o ON p.id_ingreso = o.id_ingreso AND o.attempt = p.attempts + 1),
        told AS (
          SELECT *, CASE WHEN number IS NULL THEN 'over' WHEN reply = 'ok' THEN 'issued' WHEN contains(reply, 'invalid_total_payments') THEN
                         CASE WHEN NOT corrected AND regexp_matches(reply, 'calculated is\\s*[0-9]') THEN 'correct' ELSE 'error' END
                         WHEN contains(reply, 'already') THEN 'renumber'
                         WHEN contains(lower(reply), 'rate limit') OR contains(reply, 'requests_limit') OR contains(reply, 'product_service') THEN 'again'
                         ELSE 'error' END AS step,
                    CASE WHEN number IS NULL THEN 'limit_reached' WHEN reply = 'ok' THEN 'ok'
                         WHEN contains(reply, 'invalid_total_payments') THEN 'total_mismatch' ELSE 'error' END AS category
          FROM asked)
   SELECT {KEY}, k, CASE WHEN step = 'correct' THEN CAST(regexp_extract(reply, 'calculated is\\s*([0-9]+(?:\\.[0-9]+)?)', 1) AS DECIMAL(38,2))
                         ELSE value END, attempts + CASE WHEN step = 'over' THEN 0 ELSE 1 END, step = 'correct', step, category, number, top, round + 1
   FROM told WHERE round < 20
   UNION ALL
   SELECT NULL, NULL, NULL, avail.k, NULL, 0, false, 'spare', '', NULL, 0, 0 FROM avail, n WHERE j > r AND EXISTS (SELECT 1 FROM placed WHERE round < 20)))
"""


@query("billing_retry", billing_sql(RETRY + f"""
SELECT {KEY}, CASE WHEN step = 'issued' THEN number END AS number, CAST(value AS DECIMAL(38,2)) AS value, attempts,
       CASE WHEN step = 'issued' THEN 'issued' ELSE 'rejected' END AS outcome,
       CASE WHEN step IN ('issued', 'error', 'over') THEN category ELSE 'too_many_attempts' END AS reason
FROM tries WHERE step IN ('issued', 'error', 'over') OR round = 20 AND step IN ('again', 'correct', 'renumber')""",
                                    ["provider_replies", "provider_numbers"]).replace("WITH ", "WITH RECURSIVE ", 1))
def q_billing_retry(spark, sf):
    # read in every round, derived once
    taken = materialise(A.load(spark, sf, "provider_numbers"), "checkpoint").withColumn("_taken", F.lit(True))
    stored, told = A.load(spark, sf, "provider_replies"), []

    def ask(proposals):
        """The provider's replies of a round, as its reply table has them; a number it knows is refused whatever the row.

        Later rounds ask for rows of the first one only, so its rows' replies
        are kept and the table is not read again.
        """
        if not told:
            told.append(materialise(stored.join(proposals.select("id_ingreso").distinct(), "id_ingreso", "left_semi"), "checkpoint"))
        every = told[0].filter("attempt = 0").select("id_ingreso", F.col("reply").alias("_every"))
        own = told[0].filter("attempt > 0").withColumnRenamed("reply", "_own")
        j = (proposals.join(taken, "number", "left").join(every, "id_ingreso", "left")
             .join(own, ["id_ingreso", "attempt"], "left"))
        return j.withColumn("reply", F.when(F.col("_taken"), "The number already exists")
                            .otherwise(F.coalesce("_every", "_own", F.lit("ok")))).drop("_taken", "_every", "_own")

    return _run(spark, sf).settle(ask)


@query("reply_triage", with_views(["reply_log"], """
SELECT id_ingreso, attempt, reply,
       CASE WHEN lower(trim(coalesce(reply, ''))) = 'ok' THEN 'ok'
            WHEN contains(coalesce(reply, ''), 'invalid_total_payments') THEN 'total_mismatch'
            WHEN contains(coalesce(reply, ''), 'already_exists') OR contains(coalesce(reply, ''), 'number already exists')
                 THEN 'duplicate_number'
            WHEN contains(coalesce(reply, ''), 'requests_limit') OR contains(coalesce(reply, ''), 'Rate limit')
                 THEN 'rate_limit'
            WHEN contains(coalesce(reply, ''), 'product_service') THEN 'service_down'
            ELSE 'error' END AS category,
       CASE WHEN contains(coalesce(reply, ''), 'invalid_total_payments') AND lower(trim(coalesce(reply, ''))) <> 'ok'
            THEN try_cast(nullif(regexp_extract(reply, 'calculated is\\s*([0-9]+(?:\\.[0-9]+)?)', 1), '')
                          AS DECIMAL(38,2)) END AS expected_total
FROM reply_log"""))
def q_reply_triage(spark, sf):
    return B.reply_triage(A.load(spark, sf, "reply_log"))
