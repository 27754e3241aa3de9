"""Live balance per account and last-update dates.

live balance = official total at the account's last load date
             + approved requests not yet booked in the ledger
             - approved withdrawals (charged to the withdrawing account)
               not yet booked in that account's ledger.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.numbers import MONEY_SUM, safe_money, sign_label
from ledgerloom.functions.text import NULL_WORDS, utrim


def _zero():
    return F.lit(0).cast(MONEY_SUM)


def folded(c) -> F.Column:
    return F.lower(utrim(c))


def last_update(ledger: DataFrame) -> DataFrame:
    """Last and first load date per account (one partial aggregate)."""
    return (ledger.groupBy("casillero")
            .agg(F.max("fecha_carga").alias("last_load"),
                 F.min("fecha_carga").alias("first_load")))


def partial_totals(ledger: DataFrame) -> DataFrame:
    """(casillero, last_load, best): maxima, so partials of several loads combine by their maximum."""
    is_total = ((folded("tipo") == "total") & F.col("fecha_carga").isNotNull()
                & F.col("monto").isNotNull())
    best = F.max(F.when(is_total, F.struct(F.col("fecha_carga").alias("d"),
                                           (-F.col("monto")).alias("neg"))))
    return ledger.groupBy("casillero").agg(F.max("fecha_carga").alias("last_load"), best.alias("best"))


def official_totals(ledger: DataFrame) -> DataFrame:
    """Official total per account in one aggregation pass.

    The total is taken at the account's last load date; when that date has
    no total, at the last date that has one (``stale_total``).  Several
    totals on the chosen day: the lowest.  ``max(struct(date, -amount))``
    picks both at once, so there is no self-join and the aggregate is
    combined map-side (skew-safe).
    """
    return totals_of(partial_totals(ledger))


def totals_of(partials: DataFrame) -> DataFrame:
    """Official totals from one partial an account."""
    return partials.select(
        "casillero", "last_load",
        F.col("best.d").alias("last_total_date"),
        (-F.col("best.neg")).cast(MONEY_SUM).alias("base_total"),
        (F.col("best").isNotNull() & (F.col("best.d") < F.col("last_load"))).alias("stale_total"),
    )


def pending_movements(ledger: DataFrame | None, requests: DataFrame, booked: DataFrame | None = None) -> DataFrame:
    """Approved requests / withdrawals whose id is not an order in the ledger.

    Requests count for their own account (in); withdrawals count for the
    withdrawing account A (out, the stored charge).  Both probes go through
    one anti join on (account, trimmed id) instead of two.  ``booked`` (acct,
    key) stands for the ledger's orders where they are kept apart; bucketed by
    these keys it is joined without a shuffle.
    """
    approved = requests.filter(folded("estado") == "aprobada")
    incoming = approved.select(
        F.col("casillero").alias("acct"), utrim("id").alias("key"),
        F.lit("in").alias("side"), safe_money("monto").alias("amount"))
    w = utrim("mayorista_retira")
    outgoing = (approved
                .filter(F.col("mayorista_retira").isNotNull() & ~F.lower(w).isin(NULL_WORDS))
                .select(w.alias("acct"), utrim("id_retiro").alias("key"),
                        F.lit("out").alias("side"), safe_money("egreso_retiro").alias("amount")))
    probes = incoming.unionByName(outgoing)
    if booked is None:
        booked = ledger.select(F.col("casillero").alias("acct"), utrim("orden").alias("key"))
    return probes.join(booked, ["acct", "key"], "left_anti")


def live_balance(ledger: DataFrame, requests: DataFrame, booked: DataFrame | None = None) -> DataFrame:
    return combined_balance(official_totals(ledger), pending_movements(ledger, requests, booked))


def combined_balance(tot: DataFrame, pending: DataFrame) -> DataFrame:
    """Live balance from official totals and pending movements."""
    pend = (pending
            .groupBy(F.col("acct").alias("casillero"))
            .agg(F.sum(F.when(F.col("side") == "in", F.col("amount"))).alias("pending_in"),
                 F.sum(F.when(F.col("side") == "out", F.col("amount"))).alias("pending_out"),
                 F.count_if(F.col("amount").isNull()).alias("bad_amounts")))
    j = tot.join(pend, "casillero", "full_outer")
    base = F.coalesce(F.col("base_total"), _zero())
    pin = F.coalesce(F.col("pending_in"), _zero()).cast(MONEY_SUM)
    pout = F.coalesce(F.col("pending_out"), _zero()).cast(MONEY_SUM)
    live = (base + pin - pout).cast(MONEY_SUM)
    return j.select(
        "casillero",
        base.cast(MONEY_SUM).alias("base_total"),
        pin.alias("pending_in"),
        pout.alias("pending_out"),
        live.alias("live_balance"),
        sign_label(live).alias("sign"),
        F.coalesce(F.col("stale_total"), F.lit(False)).alias("stale_total"),
        "last_load", "last_total_date",
        F.coalesce(F.col("bad_amounts"), F.lit(0).cast("bigint")).alias("bad_amounts"),
    )
