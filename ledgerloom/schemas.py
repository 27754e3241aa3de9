"""Explicit schemas of the domain tables (no inference)."""

from pyspark.sql import types as T

# Wall-clock timestamps without zone (as in the source sheets and the SQL
# oracle's TIMESTAMP); all day arithmetic runs in the session zone (UTC).
S, D, TS, B, DBL = T.StringType(), T.DecimalType(18, 2), T.TimestampNTZType(), T.BooleanType(), T.DoubleType()


def _st(*fields):
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


LEDGER = _st(("casillero", S), ("tipo", S), ("fecha", TS), ("fecha_carga", TS), ("monto", D),
             ("motivo", S), ("orden", S), ("producto", S), ("trm", DBL))

COP_LEDGER = _st(("casillero", S), ("fecha", TS), ("descripcion", S), ("egreso_extra_cop", D),
                 ("gmf_4x1000_cop", D))

# Fixed 16-column request table (+ the account it belongs to).
REQUESTS = _st(("casillero", S), ("id", S), ("descripcion", S), ("monto", D), ("fecha", S),
               ("numero_cuenta", S), ("tipo", S), ("estado", S), ("fecha_creacion", S),
               ("fecha_realizado", S), ("fecha_decision", S), ("comprobantes", S),
               ("monto_abonado", D), ("mayorista_retira", S), ("comision_pct", DBL),
               ("id_retiro", S), ("egreso_retiro", D))

# One receipt inside the JSON list of a request; every field read as text.
RECEIPT = _st(("ruta", S), ("banco", S), ("monto", S), ("fecha", S), ("cuenta", S), ("referencia", S))
RECEIPTS = T.ArrayType(RECEIPT)

REJECTS = _st(("id_ingreso", S), ("stage", S), ("reason", S))
