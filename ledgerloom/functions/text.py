"""Text, code and id cleaning as JVM-side column expressions.

All helpers take a Column (or column name) and return a Column, so they stay
inside whole-stage codegen; none of them is a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for the same results.
# ---------------------------------------------------------------------------
# Words read as "no value" by the text / id cleaners.
NULL_WORDS = ["", "nan", "none", "null", "<na>"]
# Words read as "no value" for the system-date column of bank movements.
SYSDATE_NULL_WORDS = ["", "nan", "none", "null", "na"]
# Reason keys of the income report.
REFUND_PRODUCTS = ["TOTAL", "PARCIAL"]
REFUND_REASONS = ["DEVOLUCION", "DEVOLUCIÓN"]
EXTRA_REASONS = ["INGRESO_EXTRA", "INGRESOS_EXTRA"]
REASON_REFUND = "Devolucion"
REASON_EXTRA = "Ingreso_extra"
REASON_OWN_DEPOSIT = "Consignacion cuenta propia"
# Reason keys whose order text is blanked in the income report.
BLANK_ORDER_REASONS = ["INGRESO_EXTRA", "CONSIGNACION_CUENTA_PROPIA"]
# Invalid department / city codes after zero padding.
INVALID_DEPARTMENT_CODES = ["0", "00"]
INVALID_CITY_CODES = ["0", "00000"]
# ---------------------------------------------------------------------------

# Unicode-aware white space (Java's plain \s leaves NBSP alone; the
# reference strips it). The same characters twice: a trim by a list costs a
# fraction of a pattern that is tried at every place of the text.
_WS_CHARS = "\t\n\v\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_WS_ANY = r"(?U)\s+"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def utrim(c) -> Column:
    """Trim Unicode white space on both ends (NBSP included)."""
    return F.trim(_c(c).cast("string"), F.lit(_WS_CHARS))


def is_null_word(c, words=NULL_WORDS) -> Column:
    """True when the value is null or one of the 'no value' words (folded)."""
    s = F.lower(utrim(c))
    return _c(c).isNull() | s.isin(list(words))


def clean_text(c) -> Column:
    """Null words to '', trailing '.0' dropped, trimmed."""
    s = utrim(c)
    return F.when(is_null_word(c), F.lit("")).otherwise(
        utrim(F.regexp_replace(s, r"\.0$", "")))


def digits_only(c) -> Column:
    return F.regexp_replace(F.coalesce(_c(c).cast("string"), F.lit("")), r"[^0-9]", "")


def clean_phone(c) -> Column:
    """Digits of the cleaned text."""
    return digits_only(clean_text(c))


def clean_code(c) -> Column:
    """Numeric code: digits of the cleaned text ('5.0' -> '5')."""
    return digits_only(clean_text(c))


def clean_id(c) -> Column:
    """Null words to '', trailing '.0' dropped (no second trim)."""
    s = utrim(c)
    return F.when(is_null_word(c), F.lit("")).otherwise(F.regexp_replace(s, r"\.0$", ""))


def norm_id(c) -> Column:
    """Identification without space, dot, dash or plus; zeros kept."""
    return F.regexp_replace(utrim(F.coalesce(_c(c).cast("string"), F.lit(""))), r"[ .\-+]", "")


def norm_account(c) -> Column:
    """Account key: digits only."""
    return digits_only(c)


def norm_key_text(c) -> Column:
    """Reference / date key: all white space dropped, lower case."""
    return F.lower(F.regexp_replace(F.coalesce(_c(c).cast("string"), F.lit("")), _WS_ANY, ""))


def reason_key(c) -> Column:
    """Reason key: trim, collapse spaces, '-' and ' ' to '_', upper.

    A null reason reads as the text 'nan', as in the reference.
    """
    s = utrim(F.coalesce(_c(c).cast("string"), F.lit("nan")))
    s = F.regexp_replace(s, _WS_ANY, " ")
    return F.upper(F.translate(s, "- ", "__"))


def zfill(c, width: int) -> Column:
    """Left zero padding that never truncates (unlike lpad)."""
    s = _c(c).cast("string")
    return F.when(F.length(s) < width, F.lpad(s, width, "0")).otherwise(s)


def blank_if_in(c, values) -> Column:
    return F.when(_c(c).isin(list(values)), F.lit("")).otherwise(_c(c))


def trailing_number(c) -> Column:
    """Trailing integer of an id ('Consignacion12' -> 12), else null."""
    s = F.regexp_extract(F.coalesce(_c(c).cast("string"), F.lit("")), r"(\d+)\s*$", 1)
    return F.when(s == "", F.lit(None).cast("bigint")).otherwise(s.try_cast("bigint"))


def safe_file_name(c) -> Column:
    return F.regexp_replace(_c(c).cast("string"), r"[^A-Za-z0-9._-]", "_")


def money_text(c) -> Column:
    """'$1,234' with half-even rounding to whole units, null stays null."""
    return F.concat(F.lit("$"), F.format_number(_c(c).cast("double"), 0))
