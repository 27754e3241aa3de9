"""Golden tests of the column functions (hand-written expectations)."""

from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.functions import numbers as N
from ledgerloom.functions import text as X


def one(spark, expr, values, typ="string"):
    df = spark.createDataFrame([(v,) for v in values], f"x {typ}")
    return [r[0] for r in df.select(expr(F.col("x")).alias("y")).collect()]


def test_clean_text(spark):
    got = one(spark, X.clean_text, ["  nan ", "None", "<NA>", "", None, "12.0", " abc ", "5.0 ", "a.0b"])
    assert got == ["", "", "", "", "", "12", "abc", "5", "a.0b"]


def test_clean_id_keeps_inner_text(spark):
    got = one(spark, X.clean_id, ["123.0", " 007 ", "nan", None, "1.234.567"])
    assert got == ["123", "007", "", "", "1.234.567"]


def test_phone_and_code(spark):
    assert one(spark, X.clean_phone, ["+57 300-12 3", "nan", "5.0"]) == ["5730012" + "3", "", "5"]
    assert one(spark, X.clean_code, ["05001.0", "5", None]) == ["05001", "5", ""]


def test_norm_id(spark):
    got = one(spark, X.norm_id, ["1.234.567", "+57 12-3", "123.0", "007", None])
    assert got == ["1234567", "5712" + "3", "1230", "007", ""]


def test_account_and_key_text(spark):
    assert one(spark, X.norm_account, ["616-184510-29", None, "616.0"]) == ["61618451029", "", "6160"]
    assert one(spark, X.norm_key_text, [" REF 12 ", "a\tb", None]) == ["ref12", "ab", ""]


def test_reason_key(spark):
    got = one(spark, X.reason_key, [" ingreso  extra ", "Ingresos-Extra", "devolución", None])
    assert got == ["INGRESO_EXTRA", "INGRESOS_EXTRA", "DEVOLUCIÓN", "NAN"]


def test_unicode_trim_strips_nbsp(spark):
    assert one(spark, X.utrim, ["  a  "]) == ["a"]


def test_zfill_never_truncates(spark):
    got = one(spark, lambda c: X.zfill(c, 8), ["7102025", "20251007000000", "", "12345678"])
    assert got == ["07102025", "20251007000000", "00000000", "12345678"]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="0123456789", max_size=12), min_size=1, max_size=8))
def test_zfill_property(spark, values):
    got = one(spark, lambda c: X.zfill(c, 5), values)
    for v, g in zip(values, got):
        assert len(g) == max(5, len(v)) and g.endswith(v)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=10)), min_size=1, max_size=8))
def test_clean_id_idempotent(spark, values):
    once = one(spark, X.clean_id, values)
    twice = one(spark, X.clean_id, once)
    for o, t in zip(once, twice):
        assert t == o or o.endswith(".0")


def test_trailing_number(spark):
    assert one(spark, X.trailing_number, ["Consignacion12", "retiro7 ", "abc", None]) == [12, 7, None, None]


def test_day_first_text(spark):
    vals = ["7102025", "07-10-2025", "2025-10-07", "20251007000000", "31022025", "20101205", "", "nan", None]
    got = one(spark, N.day_first_text, vals)
    # 2025-10-07 reads day-first as 20-25-... -> no date; 20101205 -> year 1205 -> out of range
    assert got == ["07-10-2025", "07-10-2025", "2025-10-07", "20251007000000", "31022025", "20101205", "",
                   "nan", None]


def test_money_text_half_even(spark):
    got = one(spark, X.money_text, [1234.5, 1235.5, -1234.0, None], "double")
    assert got == ["$1,234", "$1,236", "$-1,234", None]


def test_safe_money(spark):
    got = one(spark, N.safe_money, ["1e3", "1,000", "abc", "inf", "NaN", " 12.345 ", None])
    assert got == [Decimal("1000.00"), None, None, None, None, Decimal("12.35"), None]


def test_withdrawal_charge(spark):
    df = spark.createDataFrame([(Decimal("1000.00"), 1.5), (Decimal("333.33"), 0.5), (Decimal("10.00"), None)],
                               "m decimal(18,2), p double")
    got = [r[0] for r in df.select(N.withdrawal_charge("m", "p")).collect()]
    assert got == [Decimal("1015.00"), Decimal("335.00"), Decimal("10.00")]


@pytest.mark.parametrize("total,exp", [
    (Decimal("101.50"), (Decimal("100.00"), Decimal("1.26"), Decimal("0.24"))),
    (Decimal("0.00"), (Decimal("0"), Decimal("0"), Decimal("0"))),
    (Decimal("-5.00"), (Decimal("0"), Decimal("0"), Decimal("0"))),
])
def test_invoice_split_cents(spark, total, exp):
    df = spark.createDataFrame([(total,)], "t decimal(18,2)")
    g, s, v = N.invoice_split_cents(N.to_cents("t"))
    row = df.select(N.cents_to_money(g), N.cents_to_money(s), N.cents_to_money(v)).collect()[0]
    assert tuple(row) == exp


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(min_value=1, max_value=10**10), min_size=1, max_size=20))
def test_split_matches_float_reference_and_total(spark, cents):
    df = spark.createDataFrame([(c,) for c in cents], "c long")
    g, s, v = N.invoice_split_cents(F.col("c"))
    rows = df.select("c", g.alias("g"), s.alias("s"), v.alias("v")).collect()
    for r in rows:
        t = r.c / 100
        gn1 = t / 1.015
        sr = gn1 * 0.015 / 1.19
        iva = sr * 0.19
        # exact half-up cents agree with the float formula up to one cent
        assert abs(r.g - round(gn1 * 100)) <= 1 and abs(r.s - round(sr * 100)) <= 1
        assert abs(r.v - round(iva * 100)) <= 1
        assert abs((r.g + r.s + r.v) - r.c) <= 1  # total within 0.01 of T
