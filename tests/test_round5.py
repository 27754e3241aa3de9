"""Requests from forms at size, and white space."""

import re
from decimal import Decimal

from pyspark.sql import functions as F

from ledgerloom.functions.text import utrim
from ledgerloom.operators import requests
from ledgerloom.operators.sequence import ranked_within


def test_utrim_strips_what_the_unicode_pattern_strips(spark):
    chars = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000]
    texts = [x for c in chars for x in (f"{c}a{c}b{c}", c)] + ["", None, "  \n a \r\n", "a\n\n", "  　", "ab"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    old = F.regexp_replace("t", r"(?U)^\s+|\s+$", "")
    assert df.filter(~utrim("t").eqNullSafe(old)).collect() == []
    # no pattern is tried at every place of a text
    assert "regexp_replace" not in re.sub(r"\s", "", df.select(utrim("t"))._jdf.queryExecution().optimizedPlan().toString())


def _forms(spark, rows):
    return spark.createDataFrame(
        [(a, i, "x", Decimal(100), "1", "Nomina", "2024-01-02", m, 1.0) for a, i, m in rows],
        "casillero string, form_id bigint, descripcion string, monto decimal(18,2), numero_cuenta string, tipo string, "
        "fecha string, mayorista_retira string, comision_pct double")


def _requests(spark, rows):
    return spark.createDataFrame(rows, "casillero string, id string, mayorista_retira string, id_retiro string")


def test_new_rows_meet_their_accounts_without_a_join_of_all_forms(spark):
    old = _requests(spark, [("1", "Consignacion7", None, None), ("1", "Consignacion3", " 2 ", "retiro4"), (None, "Consignacion9", "3", "x")])
    forms = _forms(spark, [("1", 1, None), ("1", 2, "2"), ("1", 3, " 2"), ("5", 4, "nan"), ("5", 5, ""), ("5", 6, "3"), (None, 7, None), ("5", 8, "9")])
    accounts = spark.createDataFrame([("2", "Dos", None), ("2", "Two", "Zwei"), ("3", "Tres", None), ("", "blank", None), ("", "blank too", None)],
                                     "code string, name string, override string")
    new = requests.new_request_rows(old, forms, "2024-01-31", accounts)
    got = sorted((r.casillero, r.id, r.id_retiro or "", r.descripcion) for r in new.collect())
    assert got == sorted([
        ("1", "Consignacion8", "", "x"),
        # an account code that is there twice gives its rows twice, blank codes too
        ("1", "Consignacion9", "retiro5", "Retiro de Dos — x"), ("1", "Consignacion9", "retiro5", "Retiro de Zwei — x"),
        ("1", "Consignacion10", "retiro6", "Retiro de Dos — x"), ("1", "Consignacion10", "retiro6", "Retiro de Zwei — x"),
        ("5", "Consignacion1", "", "x"), ("5", "Consignacion2", "", "x"), ("5", "Consignacion2", "", "x"),
        ("5", "Consignacion3", "retiro1", "Retiro de Tres — x"), ("5", "Consignacion4", "retiro1", "Retiro de 9 — x")])
    plan = new._jdf.queryExecution().executedPlan().toString()
    # the ranks come with the rows: nothing is joined back by rank
    assert "_rq" not in "".join(re.findall(r"hashpartitioning\(([^)]*)\)", plan))


def test_next_ids_read_the_requests_once(spark):
    old = _requests(spark, [("1", "Consignacion7", None, None), ("1", "Consignacion3", " 2 ", "retiro4"), (None, "Consignacion9", "1", "retiro8")])
    got = requests.next_ids(old)
    assert sorted((r[0] or "", r[1], r[2]) for r in got.collect()) == [
        ("", "Consignacion10", "retiro1"), ("1", "Consignacion8", "retiro9"), ("2", "Consignacion1", "retiro5")]
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_ranked_within_brings_what_stands_beside_the_groups(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), "id")
    beside = spark.createDataFrame([(0, "a"), (1, "b")], "g bigint, name string")
    got = {(r.g, r.id): (r.seq, r.name) for r in ranked_within(df, ["g"], ["id"], num_partitions=8, beside=[beside]).collect()}
    assert got == {(i % 3, i): (i // 3 + 1, {0: "a", 1: "b"}.get(i % 3)) for i in range(1000)}
