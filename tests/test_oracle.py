"""Every registered query against its DuckDB oracle on the small tables."""

import pytest

import __spark_entry__ as E
from scripts.check_oracle import digest
from tests.conftest import SF_SMALL

ORACLE = E.oracle_sql()
QUERIES = E.queries()


def test_every_query_is_registered_with_oracle_or_marked_rows_only():
    rows_only = {k for k in set(QUERIES) - set(ORACLE) if k != "pipeline" and not k.startswith("op")}
    assert rows_only == {"receipt_settlement_stream"}
    assert len(QUERIES) >= 50


@pytest.fixture(scope="module")
def con(duck):
    return duck(SF_SMALL)


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_query_matches_oracle(spark, con, key):
    df = QUERIES[key](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    rel = con.sql(ORACLE[key])
    orows = rel.fetchall()
    assert sorted(df.columns) == sorted(rel.columns)
    assert len(rows) == len(orows)
    assert digest(df.columns, rows)[0] == digest(rel.columns, orows)[0]


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "live_balance" in df.columns
