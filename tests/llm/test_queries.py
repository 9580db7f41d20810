"""The operators' queries against their SQL in DuckDB, on the smallest tables."""

import pytest

from meterloom.llm.queries import ORACLE_SQL, QUERIES
from tests.test_queries import duck, rows_of  # noqa: F401


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, duck, sf, name):  # noqa: F811
    frame, r = QUERIES[name](spark, sf), duck.sql(ORACLE_SQL[name])
    assert sorted(frame.columns) == sorted(r.columns)
    assert rows_of(frame.columns, frame.collect()) == rows_of(r.columns, r.fetchall())
