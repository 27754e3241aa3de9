"""Client master data: cleaning, lookup, validation, movement assignment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.numbers import safe_money
from ledgerloom.operators.sequence import materialise
from ledgerloom.functions.text import (INVALID_CITY_CODES, INVALID_DEPARTMENT_CODES, SYSDATE_NULL_WORDS,
                                       blank_if_in, clean_id, digits_only, norm_id, utrim, zfill)
from ledgerloom.sources.headers import CLIENT_HEADERS, apply_headers
from ledgerloom.sources.readers import normalise_sysdate

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for the same results.
# ---------------------------------------------------------------------------
REQUIRED = ["identificacion", "nombres", "apellidos", "direccion", "codigo_departamento",
            "codigo_ciudad", "telefono", "correo"]
# Defaults filled only where the client has an id and the value is null.
# The seller identification is configuration (``seller_id``), not a constant.
STATIC_DEFAULTS = {
    "tipo_identificacion": "13",
    "tipo": "Es persona",
    "codigo_pais": "Col",
    "tipo_regimen_iva": "0",
    "codigo_responsabilidad_fiscal": "R-99-PN",
    "identificacion_vendedor": None,
    "clientes": "SI",
    "estado": "Activo",
}
# Contact fields taken from another column when null.
DERIVED_FROM = {"nombres_contacto": "nombres", "apellidos_contacto": "apellidos",
                "telefono_contacto": "telefono"}
EMAIL_PATTERN = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
PHONE_PATTERN = r"^[0-9]{6,20}$"
# Amount columns looked at when dropping negative movements.
MOVEMENT_AMOUNT_COLUMNS = ["monto_cop_compact", "monto_cop_upper", "monto_cop", "valor", "valor_upper",
                           "valor_total", "valor_total_upper", "monto"]
# Reference columns compared with the noise phrase.
MOVEMENT_REFERENCE_COLUMNS = ["referencia", "referencia_1", "referencia_2", "descripcion",
                              "descripcion_plain", "descripcion_motivo"]
NOISE_PHRASES = ["ABONO INTERESES AHORROS"]
# Worklist columns, in the order shown.
WORKLIST_COLUMNS = ["id_ingreso", "id_cliente", "factura", "fecha_sistema", "fecha", "descripcion",
                    "descripcion_motivo", "documento", "transaccion", "oficina_recaudo", "id_origen_destino",
                    "referencia", "referencia_1", "referencia_2", "valor", "valor_upper", "valor_total",
                    "monto", "monto_cop_upper", "producto"]
# ---------------------------------------------------------------------------


def _strip_dot0(c):
    return F.regexp_replace(utrim(F.col(c).cast("string")), r"\.0$", "")


def clients_clean(clients: DataFrame, seller_id: str | None = None) -> DataFrame:
    """Clean client master data; required columns first, then the rest.

    Codes: text, '.0' dropped, zero-padded without truncation (department 2,
    city 5), invalid zero codes blanked.  Defaults and derived contact
    fields fill nulls only where the client has an id.
    """
    df = clients
    for c in REQUIRED:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    dep = blank_if_in(zfill(F.coalesce(_strip_dot0("codigo_departamento"), F.lit("")), 2),
                      INVALID_DEPARTMENT_CODES)
    city = blank_if_in(zfill(F.coalesce(_strip_dot0("codigo_ciudad"), F.lit("")), 5), INVALID_CITY_CODES)
    df = df.withColumns({
        "codigo_departamento": dep,
        "codigo_ciudad": city,
        "telefono": _strip_dot0("telefono"),
        "identificacion": F.col("identificacion").cast("string"),
        "id_norm": norm_id("identificacion"),
    })
    has_id = F.col("identificacion").isNotNull() & (utrim("identificacion") != "")
    defaults = dict(STATIC_DEFAULTS)
    defaults["identificacion_vendedor"] = seller_id
    fills = {}
    for c, v in defaults.items():
        cur = F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string")
        fills[c] = F.when(has_id, F.coalesce(cur, F.lit(v).cast("string"))).otherwise(cur)
    for c, src in DERIVED_FROM.items():
        cur = F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string")
        fills[c] = F.when(has_id, F.coalesce(cur, F.col(src))).otherwise(cur)
    df = df.withColumns(fills)
    rest = [c for c in df.columns if c not in REQUIRED]
    return df.select(*REQUIRED, *rest)


def load_clients(raw: DataFrame, seller_id: str | None = None) -> DataFrame:
    """Client sheet with its own headers, cleaned."""
    return clients_clean(apply_headers(raw, CLIENT_HEADERS), seller_id)


def client_lookup(clients: DataFrame, probes: DataFrame, probe_col: str = "probe") -> DataFrame:
    """Clients whose raw id or normalised id equals the probe (exact).

    An OR condition would force a nested-loop join; instead two equi-joins
    (raw key, normalised key) are unioned and de-duplicated.
    """
    p = (probes.select(F.col(probe_col).alias("probe"))
         .filter(F.col("probe").isNotNull() & (utrim("probe") != "")).distinct()
         .withColumn("_raw", utrim("probe")).withColumn("_norm", norm_id("probe")))
    c = clients.withColumn("_craw", utrim("identificacion")).withColumn("_cnorm", utrim("id_norm"))
    cols = [c[x] for x in clients.columns]
    by_raw = p.join(c, p["_raw"] == c["_craw"]).select(p["probe"], *cols)
    by_norm = p.join(c, p["_norm"] == c["_cnorm"]).select(p["probe"], *cols)
    return by_raw.unionByName(by_norm).distinct()


def client_validation(forms: DataFrame, clients: DataFrame) -> DataFrame:
    """Reason per new-client form (null = valid), in the reference's order:
    missing field, e-mail, phone (6-20 digits), already existing id.
    """
    missing = None
    for c in REQUIRED:
        m = F.col(c).isNull() | (utrim(F.col(c).cast("string")) == "")
        missing = m if missing is None else (missing | m)
    raw_keys = clients.select(utrim("identificacion").alias("_k")).distinct()
    norm = utrim("id_norm") if "id_norm" in clients.columns else norm_id("identificacion")
    norm_keys = clients.select(norm.alias("_k")).distinct()
    f = (forms.withColumn("_raw", utrim("identificacion")).withColumn("_norm", norm_id("identificacion")))
    f = (f.join(raw_keys.withColumn("_hit_raw", F.lit(True)), f["_raw"] == raw_keys["_k"], "left").drop("_k")
         .join(norm_keys.withColumn("_hit_norm", F.lit(True)), F.col("_norm") == norm_keys["_k"], "left").drop("_k"))
    email_ok = utrim("correo").rlike(EMAIL_PATTERN)
    phone_ok = digits_only("telefono").rlike(PHONE_PATTERN)
    exists = F.coalesce(F.col("_hit_raw"), F.lit(False)) | F.coalesce(F.col("_hit_norm"), F.lit(False))
    reason = (F.when(missing, F.lit("missing_fields"))
              .when(~email_ok, F.lit("bad_email"))
              .when(~phone_ok, F.lit("bad_phone"))
              .when(exists, F.lit("duplicate_id")))
    return f.withColumn("reason", reason).drop("_raw", "_norm", "_hit_raw", "_hit_norm")


def _present(df: DataFrame, names) -> list[str]:
    return [c for c in names if c in df.columns]


def movement_filters(movements: DataFrame) -> DataFrame:
    """Drop movements with a negative amount in any present amount column
    (unreadable amounts do not count) or a noise phrase in any reference."""
    amounts = _present(movements, MOVEMENT_AMOUNT_COLUMNS)
    refs = _present(movements, MOVEMENT_REFERENCE_COLUMNS)
    neg = F.lit(False)
    for c in amounts:
        neg = neg | F.coalesce(safe_money(c) < 0, F.lit(False))
    noise = F.lit(False)
    for c in refs:
        noise = noise | F.coalesce(F.upper(utrim(c)).isin(NOISE_PHRASES), F.lit(False))
    return movements.filter(~neg & ~noise)


def movement_worklist(movements: DataFrame) -> DataFrame:
    """Movements to assign to clients: filtered, system date normalised and
    filled from the first 10 characters of ``id_ingreso`` where blank."""
    df = movement_filters(normalise_sysdate(movements))
    if "fecha_sistema" not in df.columns:
        df = df.withColumn("fecha_sistema", F.lit(None).cast("string"))
    blank = F.col("fecha_sistema").isNull() | F.lower(utrim("fecha_sistema")).isin(SYSDATE_NULL_WORDS)
    df = df.withColumn("fecha_sistema", F.when(blank, F.substring(F.col("id_ingreso").cast("string"), 1, 10))
                       .otherwise(F.col("fecha_sistema")))
    keys = _present(df, ["casillero", "source_file"])
    return df.select(*keys, *_present(df, WORKLIST_COLUMNS))


def changed_assignments(movements: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits (id_ingreso, nuevo_id_cliente) that change the client id,
    compared null-safe on cleaned ids (quirk Q12 fixed)."""
    cur = movements.select("casillero", "source_file", "id_ingreso",
                           clean_id("id_cliente").alias("_old"))
    e = edits.withColumn("_new", utrim(F.coalesce(F.col("nuevo_id_cliente").cast("string"), F.lit(""))))
    # one edit and one current value a key; null ids are keys like others
    keys = ["casillero", "source_file", "id_ingreso"]
    e = e.groupBy(*keys).agg(F.max("_new").alias("_new"))
    cur = cur.select(*[F.col(k).alias(f"_m_{k}") for k in keys], "_old").distinct()
    j = e.join(cur, _same(e, cur, keys))
    changed = j.filter(~(F.col("_old").eqNullSafe(F.col("_new"))))
    return changed.select(*keys, "_new").distinct()


def _same(left: DataFrame, right: DataFrame, keys: list[str]):
    """Null-safe equality of keys with ``_m_<key>``."""
    on = F.lit(True)
    for k in keys:
        on = on & left[k].eqNullSafe(right[f"_m_{k}"])
    return on


def assignment_check(movements: DataFrame, edits: DataFrame, clients: DataFrame) -> DataFrame:
    """New non-empty client ids of changed rows that are not in the client
    table (raw ids, trimmed): distinct, per source file."""
    ch = changed_assignments(movements, edits).filter(F.col("_new") != "")
    valid = clients.select(utrim("identificacion").alias("_new")).distinct()
    return (ch.join(valid, "_new", "left_anti")
            .select("casillero", "source_file", F.col("_new").alias("id_cliente")).distinct())


def assignment_apply(movements: DataFrame, edits: DataFrame, clients: DataFrame) -> DataFrame:
    """Apply changed client ids to the *full* movement table (quirk Q8).

    As in the reference a file's edits are saved only when none of its new
    ids is missing from the client table; ``applied`` marks updated rows.
    """
    # the changes are computed once, for the flags of their files and for themselves
    ch = materialise(changed_assignments(movements, edits), "checkpoint")
    valid = clients.select(utrim("identificacion").alias("_new")).distinct()
    # emptied ids need no client; they are many and would meet in one task
    bad = ch.filter(F.col("_new") != "").join(valid, "_new", "left_anti").select("casillero", "source_file").distinct()
    ok = ch.join(bad, ["casillero", "source_file"], "left_anti").select(
        F.col("casillero").alias("_m_casillero"), F.col("source_file").alias("_m_source_file"),
        F.col("id_ingreso").alias("_m_id_ingreso"), F.col("_new").alias("_apply"))
    keys = ["casillero", "source_file", "id_ingreso"]
    j = movements.join(ok, _same(movements, ok, keys), "left").drop(*[f"_m_{k}" for k in keys])
    return (j.withColumn("applied", F.col("_apply").isNotNull())
            .withColumn("id_cliente", F.when(F.col("applied"), F.col("_apply")).otherwise(F.col("id_cliente")))
            .drop("_apply"))


def append_clients(clients: DataFrame, forms: DataFrame, seller_id: str | None = None) -> DataFrame:
    """Valid new-client forms appended to the client table, then cleaned like
    the rest; invalid forms are returned by ``client_validation`` with their
    reason. Values are trimmed, a phone is stored as its digits. Of two forms
    of one id in a batch the first (by ``form_id``, else by its texts) stands.
    """
    ok = client_validation(forms, clients).filter(F.col("reason").isNull())
    new = ok.select(norm_id("identificacion").alias("_k"), F.col("form_id") if "form_id" in forms.columns else F.lit(0).alias("form_id"),
                    *[(digits_only(c) if c == "telefono" else utrim(F.col(c).cast("string"))).alias(c) for c in REQUIRED])
    first = F.min_by(F.struct(*REQUIRED), F.struct("form_id", *REQUIRED))
    new = new.groupBy("_k").agg(first.alias("_f")).select("_f.*")
    return clients_clean(clients.unionByName(new, allowMissingColumns=True), seller_id)
