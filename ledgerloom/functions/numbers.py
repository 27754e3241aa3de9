"""Number, date and money expressions (JVM-side)."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for the same results.
# ---------------------------------------------------------------------------
# Invoice split of a charged total T:
#   third-party income GN1 = T / 1.015
#   commission base  SR02 = GN1 * 0.015 / 1.19
#   VAT              IVA  = SR02 * 0.19
THIRD_PARTY_DIVISOR = "1.015"
COMMISSION_RATE = "0.015"
VAT_DIVISOR = "1.19"
VAT_RATE = "0.19"
# Amount columns tried in order for the invoice total.
INVOICE_AMOUNT_COLUMNS = ["monto_cop_compact", "monto_cop", "monto_cop_upper", "monto"]
# Spread added to the USD rate of policy accounts.
RATE_SPREAD = 100
# Years pandas can represent; outside them a parsed date is "not a date".
MIN_YEAR, MAX_YEAR = 1677, 2262
# Necessary shape of an 8-digit day-first date (day 01-31, month 01-12).
DAY_FIRST_SHAPE = r"^(0[1-9]|[12][0-9]|3[01])(0[1-9]|1[0-2])[0-9]{4}$"
# ---------------------------------------------------------------------------

MONEY = "decimal(18,2)"
MONEY_SUM = "decimal(38,2)"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_double(c) -> Column:
    """Number or null; NaN and text that is no number become null."""
    d = _c(c).try_cast("double")
    return F.when(F.isnan(d), F.lit(None).cast("double")).otherwise(d)


def finite_double(c) -> Column:
    d = safe_double(c)
    return F.when(d.isin(float("inf"), float("-inf")), F.lit(None).cast("double")).otherwise(d)


def safe_money(c) -> Column:
    """Money rounded to cents, null when not a finite number or too large.

    Numbers go through a wide decimal, so decimals keep their digits.
    """
    return F.coalesce(_c(c).try_cast("decimal(38,12)"), finite_double(c).try_cast("decimal(38,12)")).try_cast(MONEY)


def safe_timestamp(c, fmt: str | None = None) -> Column:
    """Wall-clock timestamp (no zone) or null when the text is no date."""
    s = _c(c)
    if fmt is None:
        return s.cast("string").try_cast("timestamp_ntz")
    return F.try_to_timestamp(s.cast("string"), F.lit(fmt)).cast("timestamp_ntz")


def in_pandas_range(ts: Column) -> Column:
    y = F.year(ts)
    return (y >= MIN_YEAR) & (y <= MAX_YEAR)


def day_first_parse(c) -> Column:
    """Timestamp of system-date text read day-first (digits padded to 8),
    null when it is no date or outside the years pandas can hold."""
    from ledgerloom.functions.text import digits_only, utrim, zfill

    s8 = zfill(digits_only(utrim(c)), 8)
    # only text shaped like ddMMyyyy reaches the parser (most invalid input
    # never pays for a failed parse)
    ts = F.when(s8.rlike(DAY_FIRST_SHAPE), F.try_to_timestamp(s8, F.lit("ddMMyyyy")))
    return F.when(in_pandas_range(ts), ts)


def day_first_format(parsed: Column, original) -> Column:
    """'dd-MM-yyyy' of a parsed system date, else the trimmed original."""
    from ledgerloom.functions.text import utrim
    return F.when(parsed.isNotNull(), F.date_format(parsed, "dd-MM-yyyy")).otherwise(utrim(original))


def day_first_text(c) -> Column:
    """System date text: 'dd-MM-yyyy' where it reads day-first, else the
    trimmed original.  (Column form; ``readers.normalise_sysdate`` computes
    the parse once as a column instead of three times.)"""
    return day_first_format(day_first_parse(c), c)


def withdrawal_charge(amount, pct) -> Column:
    """round(amount * (1 + pct/100), 2) in exact decimal arithmetic."""
    a = _c(amount).cast(MONEY)
    p = F.coalesce(_c(pct).cast("decimal(9,4)"), F.lit(0).cast("decimal(9,4)"))
    return F.round(a * (F.lit(100).cast("decimal(9,4)") + p) * F.lit("0.01").cast("decimal(3,2)"), 2).cast(MONEY)


def remaining(requested, paid) -> Column:
    return F.greatest(_c(requested) - _c(paid), F.lit(0).cast(MONEY)).cast(MONEY_SUM)


def sign_label(c) -> Column:
    return F.when(_c(c) >= 0, F.lit("green")).otherwise(F.lit("red"))


def to_cents(c) -> Column:
    """Money to integer cents (exact for decimal(18,2))."""
    return (_c(c).cast(MONEY) * 100).cast("bigint")


def round_ratio_half_up(num: Column, den: int) -> Column:
    """round(num / den) half away from zero for non-negative integers (decimal).

    Exact: the remainder is taken off before dividing, so the quotient is whole.
    """
    n = (num.cast("decimal(38,0)") * 2 + F.lit(den)).cast("decimal(38,0)")
    d = F.lit(2 * den).cast("decimal(38,0)")
    return ((n - n % d) / d).cast("decimal(38,0)")


def invoice_split_cents(total_cents: Column, with_vat: bool = True):
    """Exact split of T cents (up to four decimals) into (GN1, SR02, IVA) cents.

    GN1 = T / 1.015, SR02 = GN1 * 0.015 / 1.19, IVA = SR02 * 0.19; each from
    unrounded values (T too), each rounded half up to the cent. T <= 0 gives
    zeros.
    """
    gn1 = 1 / Fraction(THIRD_PARTY_DIVISOR)
    sr02 = gn1 * Fraction(COMMISSION_RATE) / Fraction(VAT_DIVISOR)
    iva = sr02 * Fraction(VAT_RATE) if with_vat else Fraction(0)
    unit = (total_cents.cast("decimal(34,4)") * 10_000).cast("decimal(38,0)")
    zero = F.lit(0).cast("decimal(38,0)")
    return tuple(F.when(total_cents > 0, round_ratio_half_up(unit * part.numerator, part.denominator * 10_000))
                 .otherwise(zero) for part in (gn1, sr02, iva))


def cents_to_money(c: Column) -> Column:
    return (c.cast("decimal(38,0)") * F.lit("0.01").cast("decimal(3,2)")).cast(MONEY_SUM)
