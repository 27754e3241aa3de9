"""Ledger queries: balance, reports, series."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ledgerloom.operators import balance, reports
from ledgerloom.operators.balance_state import BalanceState
from ledgerloom.plans.oracle import with_views
from ledgerloom.plans.registry import query
from ledgerloom.sources import adapters as A
from ledgerloom.sources import colocated, readers, sinks


def _ledger(spark, sf):
    return A.load(spark, sf, "ledger")


# -- live balance ----------------------------------------------------------
LIVE_BALANCE_SQL = with_views(["ledger", "requests"], """
, tot AS (SELECT casillero, fecha_carga, monto FROM ledger
          WHERE lower(trim(tipo)) = 'total' AND fecha_carga IS NOT NULL AND monto IS NOT NULL),
  lastload AS (SELECT casillero, max(fecha_carga) AS last_load FROM ledger GROUP BY casillero),
  lasttot AS (SELECT casillero, max(fecha_carga) AS last_total_date FROM tot GROUP BY casillero),
  base AS (SELECT t.casillero, min(t.monto) AS base_total FROM tot t
           JOIN lasttot l ON t.casillero = l.casillero AND t.fecha_carga = l.last_total_date
           GROUP BY t.casillero),
  acct AS (SELECT l.casillero, l.last_load, lt.last_total_date, b.base_total,
                  coalesce(lt.last_total_date < l.last_load, false) AS stale_total
           FROM lastload l LEFT JOIN lasttot lt ON l.casillero = lt.casillero
           LEFT JOIN base b ON l.casillero = b.casillero),
  probes AS (SELECT casillero AS acct, trim(id) AS k, 'in' AS side, monto AS amount FROM requests
             WHERE lower(trim(estado)) = 'aprobada'
             UNION ALL
             SELECT trim(mayorista_retira), trim(id_retiro), 'out', egreso_retiro FROM requests
             WHERE lower(trim(estado)) = 'aprobada' AND mayorista_retira IS NOT NULL
               AND lower(trim(mayorista_retira)) NOT IN ('', 'nan', 'none', 'null', '<na>')),
  pend AS (SELECT acct AS casillero,
                  sum(CASE WHEN side = 'in' THEN amount END) AS pending_in,
                  sum(CASE WHEN side = 'out' THEN amount END) AS pending_out,
                  count(*) FILTER (WHERE amount IS NULL) AS bad_amounts
           FROM probes p
           WHERE NOT EXISTS (SELECT 1 FROM ledger l WHERE l.casillero = p.acct AND trim(l.orden) = p.k)
           GROUP BY acct),
  j AS (SELECT coalesce(a.casillero, p.casillero) AS casillero,
               CAST(coalesce(a.base_total, 0) AS DECIMAL(38,2)) AS base_total,
               CAST(coalesce(p.pending_in, 0) AS DECIMAL(38,2)) AS pending_in,
               CAST(coalesce(p.pending_out, 0) AS DECIMAL(38,2)) AS pending_out,
               coalesce(a.stale_total, false) AS stale_total,
               a.last_load, a.last_total_date,
               CAST(coalesce(p.bad_amounts, 0) AS BIGINT) AS bad_amounts
        FROM acct a FULL OUTER JOIN pend p ON a.casillero = p.casillero)
SELECT casillero, base_total, pending_in, pending_out,
       CAST(base_total + pending_in - pending_out AS DECIMAL(38,2)) AS live_balance,
       CASE WHEN base_total + pending_in - pending_out >= 0 THEN 'green' ELSE 'red' END AS sign,
       stale_total, last_load, last_total_date, bad_amounts
FROM j
""")


@query("live_balance", LIVE_BALANCE_SQL)
def q_live_balance(spark, sf):
    return balance.live_balance(_ledger(spark, sf), A.load(spark, sf, "requests"))


@query("live_balance_colocated", LIVE_BALANCE_SQL)
def q_live_balance_colocated(spark, sf):
    """The same from a ledger whose orders are kept bucketed and sorted."""
    path = f"{sinks.scratch_path(spark, 'colocated', sinks.tag(sf))}-{uuid.uuid4().hex}"
    ledger = _ledger(spark, sf)
    booked = colocated.write_booked_orders(ledger, f"booked_orders_{uuid.uuid4().hex[:12]}", path, buckets=16)
    return balance.live_balance(ledger, A.load(spark, sf, "requests"), booked)


@query("live_balance_incremental", LIVE_BALANCE_SQL)
def q_live_balance_incremental(spark, sf):
    """The same from state that three loads were folded into, one of them twice."""
    state = BalanceState(spark, f"{sinks.scratch_path(spark, 'balance-state', sinks.tag(sf))}-{uuid.uuid4().hex}")
    ledger, year = _ledger(spark, sf), F.year("fecha_carga")
    loads = [F.coalesce(year < 1995, F.lit(True)), (year >= 1995) & (year < 1997), year >= 1997]
    for number, rows in [(0, loads[0]), (1, loads[1]), (1, loads[1]), (2, loads[2])]:
        state.add_load(ledger.filter(rows), number)
    return state.balance(A.load(spark, sf, "requests"))


@query("last_update", with_views(["ledger"], """
SELECT casillero, max(fecha_carga) AS last_load, min(fecha_carga) AS first_load
FROM ledger GROUP BY casillero"""))
def q_last_update(spark, sf):
    return balance.last_update(_ledger(spark, sf))


# -- income / purchases / consolidated --------------------------------------
_REASON = """CASE WHEN upper(trim(coalesce(producto, 'nan'))) IN ('TOTAL', 'PARCIAL')
                    OR upper(replace(replace(regexp_replace(trim(coalesce(motivo, 'nan')), '\\s+', ' ', 'g'), '-', '_'), ' ', '_'))
                       IN ('DEVOLUCION', 'DEVOLUCIÓN') THEN 'Devolucion'
               WHEN upper(replace(replace(regexp_replace(trim(coalesce(motivo, 'nan')), '\\s+', ' ', 'g'), '-', '_'), ' ', '_'))
                       IN ('INGRESO_EXTRA', 'INGRESOS_EXTRA') THEN 'Ingreso_extra'
               ELSE 'Consignacion cuenta propia' END"""

INCOME_BODY = f"""
, inc AS (SELECT casillero, fecha, monto, {_REASON} AS motivo, orden, producto, trm FROM ledger
          WHERE fecha_carga IS NOT NULL AND trim(tipo) = 'Ingreso' AND monto IS NOT NULL AND monto <> 0)
"""
INCOME_SELECT = """SELECT casillero, fecha, CAST(monto AS DECIMAL(38,2)) AS monto, motivo,
       CASE WHEN motivo IN ('Ingreso_extra', 'Consignacion cuenta propia') THEN '' ELSE orden END AS orden,
       producto"""


@query("income_report", with_views(["ledger"], INCOME_BODY + INCOME_SELECT + " FROM inc"))
def q_income(spark, sf):
    return reports.income_report(_ledger(spark, sf))


PURCHASES_SELECT = """SELECT casillero, fecha, orden, CAST(monto AS DECIMAL(38,2)) AS monto, producto
FROM ledger WHERE fecha_carga IS NOT NULL AND trim(tipo) = 'Egreso'"""


@query("purchases_report", with_views(["ledger"], PURCHASES_SELECT))
def q_purchases(spark, sf):
    return reports.purchases_report(_ledger(spark, sf))


@query("consolidated", with_views(["ledger"], INCOME_BODY + f"""
{INCOME_SELECT}, 'Ingreso' AS tipo FROM inc
UNION ALL
SELECT casillero, fecha, CAST(monto AS DECIMAL(38,2)) AS monto, NULL AS motivo, orden, producto, 'Egreso' AS tipo
FROM ledger WHERE fecha_carga IS NOT NULL AND trim(tipo) = 'Egreso'"""))
def q_consolidated(spark, sf):
    return reports.consolidated(_ledger(spark, sf))


@query("cop_extras", with_views(["cop_ledger"], """
SELECT casillero, fecha, descripcion, CAST(egreso_extra_cop AS DECIMAL(38,2)) AS egreso_extra_cop,
       CAST(gmf_4x1000_cop AS DECIMAL(38,2)) AS gmf_4x1000_cop
FROM cop_ledger WHERE fecha IS NOT NULL"""))
def q_cop_extras(spark, sf):
    return reports.cop_extras(A.load(spark, sf, "cop_ledger"))


@query("fx_income", with_views(["ledger", "accounts"], f"""
, pol AS (SELECT l.* REPLACE (CASE WHEN a.usd_rate THEN l.trm + 100 END AS trm)
          FROM ledger l LEFT JOIN accounts a ON l.casillero = a.code)
, inc AS (SELECT casillero, fecha, monto, {_REASON} AS motivo, orden, producto, trm FROM pol
          WHERE fecha_carga IS NOT NULL AND trim(tipo) = 'Ingreso' AND monto IS NOT NULL AND monto <> 0)
{INCOME_SELECT}, trm, CAST(CAST(monto AS DOUBLE) * trm AS DECIMAL(38,2)) AS monto_cop FROM inc"""))
def q_fx_income(spark, sf):
    led = readers.apply_rate_policy(_ledger(spark, sf), A.load(spark, sf, "accounts"))
    return reports.income_report(led, with_rate=True)


@query("report_display", with_views(["ledger"], INCOME_BODY + """
, cons AS (""" + INCOME_SELECT + """, 'Ingreso' AS tipo FROM inc
           UNION ALL
           SELECT casillero, fecha, CAST(monto AS DECIMAL(38,2)), NULL, orden, producto, 'Egreso' FROM ledger
           WHERE fecha_carga IS NOT NULL AND trim(tipo) = 'Egreso')
SELECT casillero, strftime(fecha, '%Y-%m-%d') AS fecha, '$' || format('{:,.0f}', CAST(monto AS DOUBLE)) AS monto,
       motivo, orden, producto, tipo
FROM cons"""))
def q_report_display(spark, sf):
    return reports.display(reports.newest_first(reports.consolidated(_ledger(spark, sf)), "fecha", "orden"))


# -- series ----------------------------------------------------------------
@query("balance_series", with_views(["ledger"], """
, tot AS (SELECT casillero, fecha_carga, monto, CAST(fecha_carga AS DATE) AS dia FROM ledger
          WHERE fecha_carga IS NOT NULL AND lower(trim(tipo)) = 'total'),
  days AS (SELECT casillero, dia FROM (
             SELECT casillero, dia, row_number() OVER (PARTITION BY casillero ORDER BY dia DESC) AS rk
             FROM (SELECT DISTINCT casillero, dia FROM tot)) WHERE rk <= 7)
SELECT t.casillero, t.fecha_carga, CAST(t.monto AS DECIMAL(38,2)) AS monto,
       CASE WHEN t.monto >= 0 THEN 'green' ELSE 'red' END AS sign
FROM tot t WHERE EXISTS (SELECT 1 FROM days d WHERE d.casillero = t.casillero AND d.dia = t.dia)"""))
def q_balance_series(spark, sf):
    return reports.balance_series(_ledger(spark, sf))


def _week_sql(tipo: str, aggs: str) -> str:
    return with_views(["ledger"], f"""
, r AS (SELECT * FROM ledger WHERE fecha_carga IS NOT NULL AND trim(tipo) = '{tipo}' AND fecha IS NOT NULL),
  m AS (SELECT casillero, max(fecha) AS mx FROM r GROUP BY casillero)
SELECT r.casillero, r.fecha, {aggs}
FROM r JOIN m ON r.casillero = m.casillero
WHERE r.fecha >= m.mx - INTERVAL 6 DAYS
GROUP BY r.casillero, r.fecha""")


@query("weekly_purchases", _week_sql("Egreso", "count(*) AS n_purchases, "
                                     "CAST(coalesce(sum(r.monto), 0) AS DECIMAL(38,2)) AS sum_purchases"))
def q_weekly_purchases(spark, sf):
    return reports.weekly_purchases(_ledger(spark, sf))


@query("weekly_income", _week_sql("Ingreso", "CAST(coalesce(sum(r.monto), 0) AS DECIMAL(38,2)) AS sum_income"))
def q_weekly_income(spark, sf):
    return reports.weekly_income(_ledger(spark, sf))
