"""Every registered query against its DuckDB oracle on the sf0.001 tables
(the same compare as tools/oracle_check.py, on the smoke scale)."""

import pytest

import __spark_entry__ as entry
from tests.conftest import SMOKE

duckdb = pytest.importorskip("duckdb")

QUERIES = entry.queries()
ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    from bindscape.session import TABLES
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SMOKE}/{t}.parquet')")
    return c


def test_every_query_has_an_oracle_or_is_rows_only():
    # the training-data operators that SQL can't express have brute-force tests of their own
    rows_only = {q for q in set(QUERIES) - set(ORACLE) if q != "pipeline" and not q.startswith("op")}
    assert not rows_only
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    from tools.oracle_check import rows_of
    got = QUERIES[name](spark, SMOKE).toPandas()
    ref = con.sql(ORACLE[name]).df()
    c1, r1 = rows_of(got)
    c2, r2 = rows_of(ref)
    assert c1 == c2
    assert len(r1) == len(r2)
    assert r1 == r2


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() >= 0
    assert "split" in df.columns
