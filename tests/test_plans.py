"""Plan checks: no cartesian products, no row-at-a-time Python, pushed scans."""

import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL

BATCH = sorted(set(E.oracle_sql()))


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", BATCH)
def test_no_cartesian_or_python_udf(spark, key):
    txt = plan_text(E.queries()[key](spark, SF_SMALL))
    assert "CartesianProduct" not in txt
    assert "BatchEvalPython" not in txt and "ArrowEvalPython" not in txt
    assert "BroadcastNestedLoopJoin" not in txt
    # every window has a partition key (no single-partition window)
    for line in txt.splitlines():
        if line.strip().lstrip("+-: ").startswith("Window ["):
            assert "], [], [" not in line, line


def test_scan_prunes_columns_and_pushes_filters(spark):
    from ledgerloom.operators import balance, reports
    from ledgerloom.sources import adapters as A
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    txt = plan_text(balance.last_update(A.load(spark, SF_SMALL, "ledger")))
    # a two-column report reads two columns of the orders file
    assert "ReadSchema: struct<o_custkey:bigint,o_orderdate:timestamp_ntz>" in txt
    txt = plan_text(reports.cop_extras(A.load(spark, SF_SMALL, "cop_ledger")))
    assert "PushedFilters: [IsNotNull(o_orderstatus), Not(EqualTo(o_orderstatus,F))]" in txt


@pytest.mark.parametrize("key", ["income_report", "purchases_report", "consolidated", "fx_income", "report_display", "weekly_purchases", "weekly_income"])
def test_reports_push_the_ledger_type_to_one_scan(spark, key, tmp_path):
    from ledgerloom.plans.registry import load_all
    from ledgerloom.sources import adapters as A
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    folder = (SF_SMALL, "ledger")
    path = str(tmp_path / "ledger")
    A.derive(spark, *folder).write.parquet(path)
    A._STORED[folder] = path
    try:
        txt = plan_text(load_all()[key].build(spark, SF_SMALL))
    finally:
        del A._STORED[folder]
    scans = [line for line in txt.splitlines() if "FileScan" in line and "ledger" in line]
    want = 2 if key.startswith("weekly") else 1  # a week's last date is looked up over the same exchange
    assert 1 <= len(scans) <= want
    assert all("StringContains(tipo," in line for line in scans)
