import duckdb
import pytest
from compare import same_rows

from lodestone.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf, name):
    same_rows(spark, sf, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("n", [0, 120])
def test_candidate_statistics_where_no_row_meets_a_block(spark, sf, tmp_path, n):
    """No rows, and keys so alike that every block is over the cap: there are no candidates to add up."""
    file = f"{tmp_path}/customer.parquet"
    con = duckdb.connect()
    con.execute(f"COPY (SELECT c.* REPLACE (k * 10000 AS c_custkey) FROM (SELECT * FROM '{sf}/customer.parquet' LIMIT 1) c, range({n}) r(k)) TO '{file}' (FORMAT parquet)")
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{file}'")
    got = QUERIES["candidate_statistics"](spark, str(tmp_path))
    want = con.execute(ORACLES["candidate_statistics"])
    assert got.columns == [c[0] for c in want.description]
    assert [tuple(r) for r in got.collect()] == want.fetchall() == [(0, None, 0)]


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
