"""Every region query against SQL on expanded positions, at the smallest scale."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.exists(f"{SF}/lineitem.parquet"), reason="no test data")


def names():
    from basewise.queries import oracle_sql

    return sorted(oracle_sql())


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("lineitem", "part"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", names())
def test_same_rows(spark, db, name):
    from basewise.queries import oracle_sql, queries

    got, want = queries()[name](spark, SF).toPandas(), db.sql(oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    got, want = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    assert len(want) and got.equals(want)


def test_every_query_without_sql_runs(spark):
    from basewise.queries import oracle_sql, queries

    for name in set(queries()) - set(oracle_sql()):
        assert queries()[name](spark, SF).count(), name
