import pytest

from methyloom.llm import queries as q
from tests.oracle import assert_same, connect


@pytest.mark.parametrize("name", list(q.SQL))
def test_same_rows_as_sql(spark, sf, name):
    assert_same(spark, connect(sf), sf, q.QUERIES[name], q.SQL[name])


@pytest.mark.parametrize("name", [n for n in q.QUERIES if n not in q.SQL])
def test_runs(spark, sf, name):
    rows = q.QUERIES[name](spark, sf).collect()
    assert len({str(r) for r in rows}) == len(rows)
