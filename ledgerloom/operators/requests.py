"""Payment requests, withdrawals, receipts JSON and ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom import schemas
from ledgerloom.functions.numbers import MONEY, MONEY_SUM, remaining, safe_money, withdrawal_charge
from ledgerloom.functions.text import NULL_WORDS, safe_file_name, trailing_number, utrim
from ledgerloom.operators.sequence import materialise, ranked_within

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for the same results.
# ---------------------------------------------------------------------------
REQUEST_ID_PREFIX = "Consignacion"
WITHDRAWAL_ID_PREFIX = "retiro"
STATUS_PENDING = "pendiente"
STATUS_PARTIAL = "parcial"
STATUS_REVIEW = "en revision"
STATUS_APPROVED = "aprobada"
STATUS_REJECTED = "rechazada"
REVIEW_STATUSES = ["parcial", "en revision"]
OPEN_STATUSES = ["pendiente", "parcial"]
CHARGE_PENDING_STATUSES = ["pendiente", "parcial", "en revision"]
WITHDRAWAL_TYPE = "Retiro"
WITHDRAWAL_TEXT = "Retiro de "
WITHDRAWAL_DASH = " — "
EMPTY_RECEIPTS = "[]"
# ---------------------------------------------------------------------------

def _zero():
    return F.lit(0).cast(MONEY_SUM)


def folded_status(c="estado"):
    return F.lower(utrim(c))


def parse_receipts(c="comprobantes"):
    """JSON list of receipts -> array<struct> with text fields.

    Blank, 'nan', invalid JSON and anything that is not a JSON array read
    as the empty list (a lone object too: trap T5).  Fields are read as text
    and converted where used, so a quoted number is not lost.
    """
    s = utrim(F.col(c) if isinstance(c, str) else c)
    is_list = F.json_array_length(s).isNotNull()
    parsed = F.from_json(s, schemas.RECEIPTS)
    empty = F.array().cast(schemas.RECEIPTS)
    return F.when(is_list, F.coalesce(parsed, empty)).otherwise(empty)


def with_receipts(requests: DataFrame) -> DataFrame:
    return requests.withColumn("receipts", parse_receipts("comprobantes"))


def paid_amount(receipts_col="receipts"):
    """Sum of receipt amounts (unreadable amount counts 0), no explode."""
    return F.aggregate(F.col(receipts_col), _zero(),
                       lambda acc, x: (acc + F.coalesce(safe_money(x["monto"]), F.lit(0).cast(MONEY)))
                       .cast(MONEY_SUM))


def receipts_explode(requests: DataFrame) -> DataFrame:
    """One row per receipt of requests that have receipts (audit listing)."""
    df = with_receipts(requests).filter(F.size("receipts") > 0)
    ex = df.select("casillero", "id", "estado", F.posexplode("receipts").alias("pos", "r"))
    return ex.select(
        "casillero", "id", "estado", (F.col("pos") + 1).cast("bigint").alias("n"),
        F.col("r.ruta").alias("ruta"), F.col("r.banco").alias("banco"),
        safe_money(F.col("r.monto")).cast(MONEY_SUM).alias("monto"),
        F.col("r.fecha").alias("fecha"), F.col("r.cuenta").alias("cuenta"),
        F.col("r.referencia").alias("referencia"),
        F.concat_ws("_", safe_file_name(F.col("id")), F.col("n").cast("string")).alias("file_name"),
    )


def request_balance(requests: DataFrame, statuses=REVIEW_STATUSES) -> DataFrame:
    """Requests in the given statuses with paid and missing amounts."""
    df = with_receipts(requests).filter(folded_status().isin(list(statuses)))
    requested = F.coalesce(safe_money("monto"), F.lit(0).cast(MONEY)).cast(MONEY_SUM)
    paid = paid_amount()
    return df.select("casillero", "id", "estado", requested.alias("monto"),
                     paid.alias("paid"), remaining(requested, paid).alias("missing"),
                     F.size("receipts").cast("bigint").alias("n_receipts"))


def append_receipt(requests: DataFrame, new_receipts: DataFrame) -> DataFrame:
    """Add receipts (casillero, id, ruta, banco, monto, fecha, cuenta, referencia)
    to their requests' lists and re-encode the JSON text; the paid amount is
    recomputed.

    This writes the legacy format where one request cell holds its whole
    receipt list, so the new receipts of a request meet in one row (a
    partially aggregated ``collect_list``; the cell is as long as that one
    request's receipt list, which is the format itself).  The scalable form
    is the exploded receipt table (``receipts_explode``, settlement), which
    never gathers a request.
    """
    fields = [f.name for f in schemas.RECEIPT.fields]
    add = (new_receipts
           .select("casillero", "id", F.struct(*[F.col(f).cast("string").alias(f) for f in fields]).alias("r"),
                   F.col("arrival") if "arrival" in new_receipts.columns else F.lit(None).alias("arrival"))
           .groupBy("casillero", "id")
           .agg(F.sort_array(F.collect_list(F.struct("arrival", "r"))).alias("_new")))
    j = with_receipts(requests).join(add, ["casillero", "id"], "left")
    merged = F.concat(F.col("receipts"), F.coalesce(F.transform("_new", lambda x: x["r"]),
                                                    F.array().cast(schemas.RECEIPTS)))
    out = j.withColumn("receipts", merged)
    return (out.withColumn("comprobantes", F.to_json("receipts"))
            .withColumn("monto_abonado", paid_amount().cast(MONEY))
            .drop("_new", "receipts"))


def is_withdrawal(c="mayorista_retira"):
    v = F.col(c)
    return v.isNotNull() & ~F.lower(utrim(v)).isin(NULL_WORDS)


def withdrawals(requests: DataFrame, accounts: DataFrame | None = None) -> DataFrame:
    """Withdrawals of all accounts seen from the withdrawing account A.

    ``recibe`` is the account that collects (B, the request's own account).
    Per A: charges confirmed (approved) and pending (open / in review),
    aggregated map-side and joined back on A.  Account names come from the
    account dimension (override wins); AQE broadcasts it when small.
    """
    w = (requests.filter(is_withdrawal())
         .select(utrim("mayorista_retira").alias("retira"), F.col("casillero").alias("recibe"),
                 "id", "id_retiro", "descripcion", safe_money("monto").cast(MONEY_SUM).alias("monto"),
                 "comision_pct", safe_money("egreso_retiro").cast(MONEY_SUM).alias("egreso_retiro"), "estado"))
    st = folded_status()
    eg = F.coalesce(F.col("egreso_retiro"), _zero())
    sums = (w.groupBy("retira")
            .agg(F.sum(F.when(st == STATUS_APPROVED, eg).otherwise(_zero())).cast(MONEY_SUM).alias("egreso_confirmado"),
                 F.sum(F.when(st.isin(CHARGE_PENDING_STATUSES), eg).otherwise(_zero())).cast(MONEY_SUM)
                 .alias("egreso_pendiente")))
    out = w.join(sums, "retira")
    if accounts is not None:
        names = accounts.select(F.col("code"), F.coalesce("override", "name").alias("display"))
        out = (out.join(names.withColumnRenamed("code", "retira").withColumnRenamed("display", "retira_name"),
                        "retira", "left")
               .join(names.withColumnRenamed("code", "recibe").withColumnRenamed("display", "recibe_name"),
                     "recibe", "left"))
    return out


def next_ids(requests: DataFrame) -> DataFrame:
    """Next request id per account and next withdrawal id per withdrawing account."""
    # a withdrawal counts for two accounts; one pass over the requests
    own = F.struct(F.col("casillero").cast("string").alias("casillero"), trailing_number("id").alias("rq"),
                   F.lit(None).cast("bigint").alias("wd"))
    other = F.struct(utrim("mayorista_retira").alias("casillero"), F.lit(None).cast("bigint").alias("rq"),
                     trailing_number("id_retiro").alias("wd"))
    last = (requests.select(F.explode(F.when(is_withdrawal(), F.array(own, other)).otherwise(F.array(own))).alias("n"))
            .groupBy(F.col("n.casillero").alias("casillero"))
            .agg(F.max("n.rq").alias("_rq"), F.max("n.wd").alias("_wd")))

    def following(prefix, c):
        return F.concat(F.lit(prefix), (F.coalesce(c, F.lit(0)) + 1).cast("string"))

    return last.select("casillero", following(REQUEST_ID_PREFIX, "_rq").alias("next_request_id"),
                       following(WITHDRAWAL_ID_PREFIX, "_wd").alias("next_withdrawal_id"))


# -- new requests / withdrawals from forms -----------------------------------
def _blank(c):
    return F.col(c).isNull() | (utrim(F.col(c).cast("string")) == "")


def validate_forms(forms: DataFrame) -> DataFrame:
    """Reason per form row (null = valid), first failing check wins.

    Forms: casillero (B, the account that collects), descripcion, monto,
    numero_cuenta, optional mayorista_retira (A) and comision_pct.
    """
    wd = is_withdrawal()
    amount_missing = F.col("monto").isNull() | (F.col("monto") == 0)
    reason = (F.when(wd & (utrim("mayorista_retira") == F.col("casillero")), F.lit("same_account"))
              .when(wd & (amount_missing | _blank("numero_cuenta")), F.lit("missing_amount_or_account"))
              .when(~wd & (_blank("descripcion") | amount_missing | _blank("numero_cuenta")),
                    F.lit("missing_fields")))
    return forms.withColumn("reason", reason)


def new_request_rows(requests: DataFrame, forms: DataFrame, today, accounts: DataFrame | None = None) -> DataFrame:
    """Valid forms as new request rows with fresh ids.

    A request has the date of its form (``fecha``; without one, ``today``), a
    withdrawal has ``today`` and a text that names the withdrawing account
    by ``accounts`` (code, name, override), else by its code.

    Ids continue each account's numbering ('ConsignacionN'; withdrawals also
    get 'retiroN' per withdrawing account over all accounts); ranks come from
    the skew-safe sequence operator, not a per-account window.
    """
    ok = materialise(validate_forms(forms).filter(F.col("reason").isNull()).drop("reason"))
    # one row per account, read by two joins (collecting and withdrawing
    # account): computed once
    nxt = materialise(next_ids(requests).select(
        "casillero",
        (F.regexp_extract("next_request_id", r"(\d+)$", 1).cast("bigint")).alias("_req0"),
        (F.regexp_extract("next_withdrawal_id", r"(\d+)$", 1).cast("bigint")).alias("_wd0")))
    ok = ranked_within(ok, ["casillero"], FORM_ORDER, rank_col="_rq", beside=[nxt.select("casillero", "_req0")])
    # only withdrawals are ranked again and meet the withdrawing account; the
    # other rows, mostly without one, would meet in the task of the null key
    wd = is_withdrawal()
    own, payers = ok.filter(~wd), [nxt.select(F.col("casillero").alias("_a"), "_wd0")]
    if accounts is not None:
        payers.append(accounts.select(F.col("code").alias("_a"), F.coalesce("override", "name").alias("_name")))
        own = _as_often_as_named(own, accounts)
    withdrawn = ranked_within(ok.filter(wd).withColumn("_a", utrim("mayorista_retira")), ["_a"], FORM_ORDER,
                              rank_col="_rw", beside=payers)
    if accounts is None:
        withdrawn = withdrawn.withColumn("_name", F.lit(None).cast("string"))
    ok = withdrawn.unionByName(own, allowMissingColumns=True)
    day = F.lit(today).cast("date").cast("string")
    own_day = F.coalesce(F.col("fecha").try_cast("date").cast("string"), day) if "fecha" in ok.columns else day
    text = utrim(F.coalesce("descripcion", F.lit("")))
    withdrawal_text = F.concat(F.lit(WITHDRAWAL_TEXT), F.coalesce("_name", utrim("mayorista_retira")),
                               F.when(text != "", F.concat(F.lit(WITHDRAWAL_DASH), text)).otherwise(F.lit("")))
    new = ok.select(
        "casillero",
        F.concat(F.lit(REQUEST_ID_PREFIX), (F.coalesce("_req0", F.lit(1)) + F.col("_rq") - 1).cast("string")).alias("id"),
        F.when(wd, withdrawal_text).otherwise(utrim("descripcion")).alias("descripcion"),
        F.col("monto").cast(MONEY).alias("monto"),
        F.when(wd, day).otherwise(own_day).alias("fecha"),
        utrim("numero_cuenta").alias("numero_cuenta"),
        F.when(wd, F.lit(WITHDRAWAL_TYPE)).otherwise(F.col("tipo")).alias("tipo"),
        F.lit(STATUS_PENDING).alias("estado"),
        day.alias("fecha_creacion"),
        F.lit("").alias("fecha_realizado"), F.lit("").alias("fecha_decision"),
        F.lit(EMPTY_RECEIPTS).alias("comprobantes"),
        F.lit(0).cast(MONEY).alias("monto_abonado"),
        F.when(wd, utrim("mayorista_retira")).alias("mayorista_retira"),
        F.when(wd, F.col("comision_pct").cast("double")).alias("comision_pct"),
        F.when(wd, F.concat(F.lit(WITHDRAWAL_ID_PREFIX),
                            (F.coalesce("_wd0", F.lit(1)) + F.col("_rw") - 1).cast("string"))).alias("id_retiro"),
        F.when(wd, withdrawal_charge("monto", "comision_pct")).alias("egreso_retiro"),
    )
    return new


FORM_ORDER = ["form_id", "descripcion", "monto", "numero_cuenta", "mayorista_retira"]


def _as_often_as_named(forms: DataFrame, accounts: DataFrame) -> DataFrame:
    """Each form that is no withdrawal as often as accounts bear its blank code (at least once).

    The codes are trimmed forms of ``NULL_WORDS``, so a few dozen counts are broadcast.
    """
    blank = (accounts.filter(~is_withdrawal("code")).groupBy(F.col("code").alias("_code")).agg(F.count(F.lit(1)).alias("_times"))
             .filter((F.col("_times") > 1) & (F.col("_code") == utrim("_code"))))
    out = forms.join(F.broadcast(blank), utrim(forms["mayorista_retira"]) == F.col("_code"), "left")
    return out.withColumn("_times", F.explode(F.sequence(F.lit(1), F.coalesce("_times", F.lit(1))))).drop("_code", "_times")


def append_forms(requests: DataFrame, forms: DataFrame, today, accounts: DataFrame | None = None) -> DataFrame:
    """Requests plus the new rows of the valid forms (append)."""
    from ledgerloom.sources.readers import conform
    new = new_request_rows(requests, forms, today, accounts)
    return conform(requests, schemas.REQUESTS).unionByName(conform(new, schemas.REQUESTS))


def upsert_by_id(requests: DataFrame, updates: DataFrame) -> DataFrame:
    """Set the update columns where (casillero, id) matches; others unchanged.

    Left join plus coalesce(new, old).  Updates whose key is absent are
    returned by ``unmatched_updates`` (the reference reports them).
    Several updates of one key: the last by ``seq`` wins (pre-aggregated
    with max_by, so the join side has one row per key).
    """
    upd_cols = [c for c in updates.columns if c not in ("casillero", "id", "seq")]
    last = (updates.groupBy("casillero", "id")
            .agg(*[F.max_by(F.col(c), F.col("seq")).alias(f"_u_{c}") for c in upd_cols]))
    j = requests.join(last, ["casillero", "id"], "left")
    for c in upd_cols:
        j = j.withColumn(c, F.coalesce(F.col(f"_u_{c}").try_cast(requests.schema[c].dataType), F.col(c)))
    return j.drop(*[f"_u_{c}" for c in upd_cols])


def unmatched_updates(requests: DataFrame, updates: DataFrame) -> DataFrame:
    return updates.join(requests.select("casillero", "id"), ["casillero", "id"], "left_anti")
