"""Every query of the core with SQL gives the SQL's rows; those without run."""

import pytest

from methyloom.plans import cell_queries, cluster_queries, enrich_queries, matrix_queries, region_queries, site_queries, training_data
from tests.oracle import assert_same, connect

PLANS = (training_data, site_queries, matrix_queries, region_queries, enrich_queries, cell_queries, cluster_queries)
SQL = {n: (p.QUERIES[n], p.SQL[n]) for p in PLANS for n in p.SQL}
REST = {n: f for p in PLANS for n, f in p.QUERIES.items() if n not in p.SQL}


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", list(SQL))
def test_same_rows_as_sql(spark, sf, con, name):
    assert_same(spark, con, sf, *SQL[name])


@pytest.mark.parametrize("name", list(REST))
def test_runs(spark, sf, name):
    assert REST[name](spark, sf).columns


def test_every_sql_has_a_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert {f"p{n}_found" for n in (1, 3, 4, 7)} <= set(e.queries())
