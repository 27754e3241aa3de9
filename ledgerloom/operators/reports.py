"""Ledger reports: income, purchases, consolidated, COP extras, series."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.numbers import MONEY_SUM, sign_label
from ledgerloom.functions.text import (BLANK_ORDER_REASONS, EXTRA_REASONS, REASON_EXTRA, money_text,
                                       REASON_OWN_DEPOSIT, REASON_REFUND, REFUND_PRODUCTS,
                                       REFUND_REASONS, reason_key, utrim)

LEDGER_INCOME, LEDGER_PURCHASE, LEDGER_TOTAL = "Ingreso", "Egreso", "Total"
SERIES_DAYS = 7
WEEK_SPAN_DAYS = 6


def of_type(ledger: DataFrame, tipo: str) -> DataFrame:
    """Rows of one ledger type: trimmed, exact case (quirk Q2).

    The plain ``contains`` follows from the trimmed equality; unlike that it
    reaches the scan, where it drops row groups by their dictionary.
    """
    return of_types(ledger, [tipo])


def of_types(ledger: DataFrame, types: list[str]) -> DataFrame:
    """Rows of some ledger types, see ``of_type``."""
    pushed = reduce(or_, [F.col("tipo").contains(t) for t in types])
    return ledger.filter(pushed & utrim("tipo").isin(types))


def from_load_date(ledger: DataFrame, start=None) -> DataFrame:
    """Rows loaded on/after ``start``; rows without a load date drop.

    ``start=None`` is the reference default (each account's first load
    date), which keeps exactly the rows that have a load date.
    """
    if start is None:
        return ledger.filter(F.col("fecha_carga").isNotNull())
    return ledger.filter(F.col("fecha_carga") >= F.lit(start).cast("timestamp_ntz"))


def classify_reason(producto="producto", motivo="motivo") -> F.Column:
    prod = F.upper(utrim(F.coalesce(F.col(producto).cast("string"), F.lit("nan"))))
    key = reason_key(motivo)
    refund = prod.isin(REFUND_PRODUCTS) | key.isin(REFUND_REASONS)
    return (F.when(refund, F.lit(REASON_REFUND))
            .when(key.isin(EXTRA_REASONS), F.lit(REASON_EXTRA))
            .otherwise(F.lit(REASON_OWN_DEPOSIT)))


def _income_columns() -> dict:
    motivo = classify_reason()
    orden = F.when(reason_key(motivo).isin(BLANK_ORDER_REASONS), F.lit("")).otherwise(F.col("orden"))
    return {"motivo": motivo, "orden": orden}


def _has_amount():
    return F.col("monto").isNotNull() & (F.col("monto") != 0)


def income_report(ledger: DataFrame, start=None, with_rate: bool = False) -> DataFrame:
    """Income rows with reason class; order text blanked for extra/own deposit.

    ``with_rate`` adds ``trm`` and ``monto_cop = monto * trm`` (accounts under
    the USD policy carry a rate; others have null).
    """
    df = of_type(from_load_date(ledger, start), LEDGER_INCOME).filter(_has_amount())
    own = _income_columns()
    cols = [F.col("casillero"), F.col("fecha"), F.col("monto").cast(MONEY_SUM).alias("monto"),
            own["motivo"].alias("motivo"), own["orden"].alias("orden"), F.col("producto")]
    if with_rate:
        cols += [F.col("trm"),
                 (F.col("monto").cast("double") * F.col("trm")).cast(MONEY_SUM).alias("monto_cop")]
    return df.select(*cols)


def purchases_report(ledger: DataFrame, start=None) -> DataFrame:
    """Purchase rows; null and zero amounts are kept (quirk Q16)."""
    return (of_type(from_load_date(ledger, start), LEDGER_PURCHASE)
            .select("casillero", "fecha", "orden", F.col("monto").cast(MONEY_SUM).alias("monto"),
                    "producto"))


def consolidated(ledger: DataFrame, start=None) -> DataFrame:
    """Income and purchases in one table, labelled; amounts stay numeric (Q7).
    One scan: the label decides which columns a row has."""
    df = of_types(from_load_date(ledger, start), [LEDGER_INCOME, LEDGER_PURCHASE])
    df = df.withColumn("_type", utrim("tipo"))
    income = F.col("_type") == LEDGER_INCOME
    own = _income_columns()
    return df.filter(~income | _has_amount()).select(
        "casillero", "fecha", F.col("monto").cast(MONEY_SUM).alias("monto"), F.when(income, own["motivo"]).alias("motivo"),
        F.when(income, own["orden"]).otherwise(F.col("orden")).alias("orden"), "producto", F.col("_type").alias("tipo"))


def cop_extras(cop_ledger: DataFrame) -> DataFrame:
    """COP extra expenses and 4x1000 levy; rows without a date drop."""
    return (cop_ledger.filter(F.col("fecha").isNotNull())
            .select("casillero", "fecha", "descripcion",
                    F.col("egreso_extra_cop").cast(MONEY_SUM).alias("egreso_extra_cop"),
                    F.col("gmf_4x1000_cop").cast(MONEY_SUM).alias("gmf_4x1000_cop")))


def newest_first(df: DataFrame, date_col: str = "fecha", *tie_break: str) -> DataFrame:
    """Per-account report order: date descending, nulls last, stable tie-break.

    A distributed range sort (sampled boundaries), not a single-task sort.
    """
    return df.orderBy(F.col("casillero"), F.col(date_col).desc_nulls_last(),
                      *[F.col(c).asc_nulls_last() for c in tie_break])


def display(df: DataFrame, date_cols=("fecha",), money_cols=("monto",)) -> DataFrame:
    """Screen form: dates as 'yyyy-MM-dd' text, money as '$1,234' text."""
    out = df
    for c in date_cols:
        out = out.withColumn(c, F.date_format(F.col(c), "yyyy-MM-dd"))
    for c in money_cols:
        out = out.withColumn(c, money_text(c))
    return out


def balance_series(ledger: DataFrame, start=None, days: int = SERIES_DAYS, ordered: bool = True) -> DataFrame:
    """Total rows of each account's ``days`` most recent distinct load days.

    Distinct days per account are few (one per calendar day), so the ranking
    window runs over a small aggregated frame; the rows then come back by a
    semi join.
    """
    tot = from_load_date(ledger, start).filter(F.lower(utrim("tipo")) == "total")
    tot = tot.withColumn("dia", F.to_date("fecha_carga"))
    ranked = (tot.select("casillero", "dia").distinct()
              .withColumn("rk", F.row_number().over(
                  Window.partitionBy("casillero").orderBy(F.col("dia").desc())))
              .filter(F.col("rk") <= days).drop("rk"))
    out = tot.join(ranked, ["casillero", "dia"], "left_semi")
    out = out.select("casillero", "fecha_carga", F.col("monto").cast(MONEY_SUM).alias("monto"),
                     sign_label("monto").alias("sign"))
    # ascending for the series (at most `days` days per account)
    return out.sortWithinPartitions("casillero", "fecha_carga") if not ordered else \
        out.orderBy("casillero", "fecha_carga", "monto")


def _weekly(ledger: DataFrame, tipo: str, start, by_day: bool, **sums) -> DataFrame:
    """Sums per timestamp of ``tipo`` within [max(fecha) - 6 days, max(fecha)] per account.

    The end is the data's own last date per account, not today. Rows are
    summed per timestamp first, map-side; the account's last date is looked up
    over those sums, so no raw rows are joined on a hot account.
    """
    df = of_type(from_load_date(ledger, start), tipo).filter(F.col("fecha").isNotNull())
    per = df.groupBy("casillero", "fecha").agg(F.sum("monto").alias("_sum"), F.count(F.lit(1)).alias("_n"))
    last = per.groupBy("casillero").agg(F.max("fecha").alias("_max_f"))
    week = (per.join(last, "casillero")
            .filter(F.col("fecha") >= F.col("_max_f") - F.expr(f"INTERVAL {WEEK_SPAN_DAYS} DAYS")))
    if by_day:
        week = week.withColumn("fecha", F.to_date("fecha")).groupBy("casillero", "fecha").agg(
            F.sum("_sum").alias("_sum"), F.sum("_n").alias("_n"))
    return week.select("casillero", "fecha", *[c.alias(name) for name, c in sums.items()])


def _sum_or_zero():
    return F.coalesce(F.col("_sum"), F.lit(0)).cast(MONEY_SUM)


def weekly_purchases(ledger: DataFrame, start=None, by_day: bool = False) -> DataFrame:
    """Purchases per timestamp (or per day) in the trailing week: count and sum."""
    return _weekly(ledger, LEDGER_PURCHASE, start, by_day, n_purchases=F.col("_n"), sum_purchases=_sum_or_zero())


def weekly_income(ledger: DataFrame, start=None, by_day: bool = False) -> DataFrame:
    """Income per timestamp (or per day) in the trailing week: sum."""
    return _weekly(ledger, LEDGER_INCOME, start, by_day, sum_income=_sum_or_zero())
