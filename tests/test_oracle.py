"""Every query with an oracle text agrees with DuckDB (sf0.001 here; the driver uses sf0.01)."""

import pytest

import __spark_entry__ as E
from tests.conftest import SMALL
from tests.oracle import compare, duck

ORACLE = E.oracle_sql()
QUERIES = E.queries()


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, con, name, QUERIES[name], ORACLE[name], SMALL)
    assert r["ok"], r


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert [f.name for f in df.schema.fields] == ["actual", "predicted", "n"]
    assert sum(r["n"] for r in rows) > 0
