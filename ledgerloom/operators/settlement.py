"""Receipt settlement as a batch job (all receipts of all accounts at once).

Each receipt passes the gates in order: readable, successful transfer,
account matches (an empty requested account passes), not a duplicate.  A
duplicate is a receipt whose normalised (account, reference, date, amount)
key was already presented eligibly in the same account: *the first
presentation consumes the key*, even if its request was already closed.
Remaining receipts are applied in arrival order until one brings the paid sum
to the requested amount, or an unreadable one comes (it sends the request to
review). Either closes the request for good: a negative receipt after the
close does not open it again. A requested amount of 0 never auto-approves.

The close is found by a parallel scan: running sums over range-partitioned
slices, stitched per slice, give every receipt's paid sum as if none were
refused; the first one at which it reaches the request, a map-side minimum of
ranks over all slices, is the close, unless an unreadable one comes before.
Sums up to the close are the real ones, as all receipts before it were
applied; later ones are refused by their rank alone.

With ``requests`` (the stored table) the job starts from what is stored: the
requested amount and account, the status (receipts of a request that is not
open are ``closed`` and consume no key), the receipts accepted earlier (their
keys count as presented, in all requests of the account) and their sum. A
receipt of a request that is not stored is ``unknown_request``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.numbers import MONEY_SUM, safe_money
from ledgerloom.functions.text import norm_account, norm_key_text
from ledgerloom.operators.requests import (OPEN_STATUSES, STATUS_APPROVED, STATUS_PARTIAL, STATUS_PENDING, STATUS_REVIEW,
                                           append_receipt, folded_status, paid_amount, with_receipts)
from ledgerloom.operators.sequence import ranked_within

ORDER = ["arrival", "event_id"]
REQUEST = ["casillero", "id"]
DEDUPE_KEY = ["casillero", "k_cta", "k_ref", "k_fch", "k_mto"]


def stored_state(requests: DataFrame) -> DataFrame:
    """One row per stored request: what is requested, ``_paid0``, ``_status0``, ``_known``."""
    state = with_receipts(requests).select(
        *REQUEST, F.col("monto").alias("monto_solicitado"), F.col("numero_cuenta").alias("cuenta_solicitada"),
        paid_amount().alias("_paid0"), F.col("estado").alias("_status0"), F.lit(True).alias("_known"))
    # (casillero, id) is the table's key; a repeated one counts once
    return state.groupBy(*REQUEST).agg(F.max_by(F.struct(*state.columns[2:]), F.struct("_paid0", "_status0")).alias("_s")).select(*REQUEST, "_s.*")


def with_request_state(receipts: DataFrame, requests: DataFrame) -> DataFrame:
    """Receipts with the stored state of their request."""
    return receipts.drop("monto_solicitado", "cuenta_solicitada").join(stored_state(requests), REQUEST, "left")


def stored_keys(requests: DataFrame) -> DataFrame:
    """Distinct duplicate keys of the receipts accepted earlier."""
    r = with_receipts(requests).select("casillero", F.explode("receipts").alias("r"))
    keys = r.select("casillero", norm_account("r.cuenta").alias("k_cta"), norm_key_text("r.referencia").alias("k_ref"),
                    norm_key_text("r.fecha").alias("k_fch"), safe_money("r.monto").alias("k_mto"))
    return keys.filter((F.col("k_ref") != "") & F.col("k_mto").isNotNull()).distinct()


def receipt_keys(receipts: DataFrame) -> DataFrame:
    """Normalised duplicate key and gate flags of every receipt."""
    req_cta = norm_account("cuenta_solicitada")
    is_open = (F.coalesce(F.col("_known"), F.lit(False)) & F.coalesce(folded_status("_status0").isin(OPEN_STATUSES), F.lit(False))
               if "_known" in receipts.columns else F.lit(True))
    return receipts.withColumns({
        "_ok_req": is_open,
        "k_cta": norm_account("cuenta"),
        "k_ref": norm_key_text("referencia"),
        "k_fch": norm_key_text("fecha"),
        "k_mto": safe_money("monto"),
        "_ok_read": F.coalesce(F.col("readable"), F.lit(True)),
        "_ok_tx": F.coalesce(F.col("exitosa"), F.lit(True)),
        "_ok_cta": (req_cta == "") | (norm_account("cuenta") == req_cta),
    })


def _eligible():
    return F.col("_ok_req") & F.col("_ok_read") & F.col("_ok_tx") & F.col("_ok_cta")


def with_duplicate_flag(keyed: DataFrame, taken: DataFrame | None = None, key: list[str] = DEDUPE_KEY) -> DataFrame:
    """Add ``duplicate`` to receipts carrying ``receipt_keys`` columns.

    The first eligible presentation of each key per account is a map-side
    ``min`` aggregate (no window over a possibly hot key), joined back on the
    key.  Empty reference, unreadable amount or a failed gate: never a
    duplicate.  Keys in ``taken`` were presented before.  ``key`` without the
    account looks at the receipts of all accounts.
    """
    counted = _eligible() & (F.col("k_ref") != "") & F.col("k_mto").isNotNull()
    first = keyed.filter(counted).groupBy(*key).agg(F.min(F.struct(*ORDER)).alias("_first"))
    again = F.struct(*ORDER) != F.col("_first")
    if taken is not None:
        first = first.join(taken.select(*key).distinct().withColumn("_taken", F.lit(True)), key, "left")
        again = again | F.coalesce(F.col("_taken"), F.lit(False))
    j = keyed.join(first, key, "left")
    return j.withColumn("duplicate", counted & again).drop("_first", "_taken")


def receipt_dedupe(receipts: DataFrame, scope: str = "account") -> DataFrame:
    """Eligible receipts (readable, successful, right account) with a
    duplicate flag (see ``with_duplicate_flag``); ``scope="all"``: a receipt
    presented in any account counts."""
    if scope not in ("account", "all"):
        raise ValueError("scope is 'account' or 'all'")
    key = DEDUPE_KEY if scope == "account" else DEDUPE_KEY[1:]
    return (with_duplicate_flag(receipt_keys(receipts), key=key).filter(_eligible())
            .drop("_ok_req", "_ok_read", "_ok_tx", "_ok_cta"))


def receipt_settlement(receipts: DataFrame, requests: DataFrame | None = None) -> DataFrame:
    """Verdict per receipt and the resulting state of its request.

    verdict: unreadable | unsuccessful | wrong_account | duplicate | closed |
    applied, with ``requests`` also unknown_request.  ``paid_after`` is the request's paid sum after the receipt.
    Request columns (same on every receipt of a request): ``status``,
    ``paid``, ``first_date`` (first receipt that changed the request).
    """
    if requests is None:
        k = receipt_keys(receipts).withColumns({
            "_paid0": F.lit(0).cast(MONEY_SUM), "_status0": F.lit(STATUS_PENDING), "_known": F.lit(True)})
        k = with_duplicate_flag(k)
    else:
        k = with_duplicate_flag(receipt_keys(with_request_state(receipts, requests)), stored_keys(requests))
    verdict0 = (F.when(F.col("_known").isNull(), F.lit("unknown_request"))
                .when(~F.col("_ok_req"), F.lit("closed"))
                .when(~F.col("_ok_read"), F.lit("unreadable"))
                .when(~F.col("_ok_tx"), F.lit("unsuccessful"))
                .when(~F.col("_ok_cta"), F.lit("wrong_account"))
                .when(F.col("duplicate"), F.lit("duplicate")))
    k = k.withColumn("_v0", verdict0)
    # the sequence of events that can change a request: candidates and
    # unreadable receipts, in arrival order
    seq = k.filter(F.col("_v0").isNull() | (F.col("_v0") == "unreadable")).select(
        *REQUEST, *ORDER,
        F.when(F.col("_v0").isNull(), F.coalesce(F.col("k_mto"), F.lit(0).cast("decimal(18,2)")))
         .otherwise(F.lit(0).cast("decimal(18,2)")).cast(MONEY_SUM).alias("amt"),
        F.when(F.col("_v0") == "unreadable", F.lit(1)).otherwise(F.lit(0)).cast("bigint").alias("unread"))
    run = ranked_within(seq, REQUEST, ORDER, value_cols=["amt"], rank_col="_rk")
    requested = (k.select(*REQUEST, safe_money("monto_solicitado").cast(MONEY_SUM).alias("req"), "_paid0", "_status0")
                 .groupBy(*REQUEST).agg(F.max("req").alias("req"), F.max("_paid0").alias("_paid0"), F.max("_status0").alias("_status0")))
    run = run.join(requested.select(*REQUEST, "req", "_paid0"), REQUEST, "left")
    run = run.withColumn("_incl", F.col("_paid0") + F.col("running_amt"))
    # the first receipt that closes its request; what was paid before an open request's first receipt does not
    closes = (F.col("unread") == 1) | (F.col("req") > 0) & (F.col("_incl") >= F.col("req"))
    close = run.filter(closes).groupBy(*REQUEST).agg(F.min(F.struct("_rk", "_incl")).alias("_c"))
    run = run.join(close.select(*REQUEST, F.col("_c._rk").alias("_close"), F.col("_c._incl").alias("_closed_at")), REQUEST, "left")
    still = F.coalesce(F.col("_rk") <= F.col("_close"), F.lit(True))
    effects = run.select(*REQUEST, "event_id", still.alias("_open"), F.when(still, F.col("_incl")).otherwise(F.col("_closed_at")).alias("paid_after"),
                         "amt", "unread", "arrival")
    agg = (effects.groupBy(*REQUEST)
           .agg(F.max(F.when(F.col("_open") & (F.col("unread") == 1), 1).otherwise(0)).alias("_rev"),
                F.sum(F.when(F.col("_open") & (F.col("unread") == 0), F.col("amt"))).alias("_paid"),
                F.count_if(F.col("_open") & (F.col("unread") == 0)).alias("_n_applied"),
                F.min(F.when(F.col("_open"), F.col("arrival"))).alias("first_date")))
    status = requested.join(agg, REQUEST, "left")
    paid = (F.col("_paid0") + F.coalesce(F.col("_paid"), F.lit(0).cast(MONEY_SUM))).cast(MONEY_SUM)
    some = F.coalesce(F.col("_n_applied"), F.lit(0)) > 0
    st = (F.when(F.coalesce(F.col("_rev"), F.lit(0)) == 1, F.lit(STATUS_REVIEW))
          .when(some & (F.col("req") > 0) & (paid >= F.col("req")), F.lit(STATUS_APPROVED))
          .when(some, F.lit(STATUS_PARTIAL))
          .otherwise(F.col("_status0")))
    status = status.select(*REQUEST, st.alias("status"), paid.alias("paid"), "first_date")
    out = k.join(effects.select("event_id", "_open", "paid_after"), "event_id", "left")
    verdict = (F.when(F.col("_v0").isNotNull(), F.col("_v0"))
               .when(F.col("_open"), F.lit("applied")).otherwise(F.lit("closed")))
    out = out.select(*REQUEST, "event_id", "arrival", verdict.alias("verdict"),
                     F.col("paid_after").cast(MONEY_SUM).alias("paid_after"))
    return out.join(status, REQUEST, "left")


def settle_requests(requests: DataFrame, receipts: DataFrame) -> DataFrame:
    """The stored requests after a batch of receipts.

    Applied receipts join their request's list; status, paid sum, first
    receipt day (if blank) and decision day of an approval follow. A request
    that no receipt changed keeps its row.
    """
    verdicts = receipt_settlement(receipts, requests)
    for c in ("ruta", "banco"):
        if c not in receipts.columns:
            receipts = receipts.withColumn(c, F.lit("").cast("string"))
    applied = verdicts.filter(F.col("verdict") == "applied").select("event_id")
    new = receipts.join(applied, "event_id", "left_semi")
    after = (verdicts.filter(F.col("first_date").isNotNull()).groupBy(*REQUEST)
             .agg(F.max("status").alias("_st"), F.max("paid").alias("_paid"), F.max(F.to_date("first_date")).alias("_day"),
                  F.max(F.when(F.col("verdict") == "applied", F.to_date("arrival"))).alias("_last")))
    old_paid = F.col("monto_abonado") if "monto_abonado" in requests.columns else F.lit(None).cast(MONEY_SUM)
    out = append_receipt(requests.withColumns({"_old": old_paid, "_list": F.col("comprobantes")}), new)
    out = out.join(after, REQUEST, "left")
    blank = F.coalesce(F.lower(F.trim("fecha_realizado")), F.lit("")).isin("", "nan")
    changed = F.col("_st").isNotNull()
    return out.withColumns({
        "monto_abonado": F.when(changed, F.col("_paid")).otherwise(F.col("_old")).cast(MONEY_SUM),
        "fecha_realizado": F.when(changed & blank, F.col("_day").cast("string")).otherwise(F.col("fecha_realizado")),
        "fecha_decision": F.when(F.col("_st") == STATUS_APPROVED, F.col("_last").cast("string")).otherwise(F.col("fecha_decision")),
        "comprobantes": F.when(changed, F.col("comprobantes")).otherwise(F.col("_list")),
        "estado": F.coalesce("_st", "estado"),
    }).drop("_st", "_paid", "_day", "_last", "_old", "_list")
