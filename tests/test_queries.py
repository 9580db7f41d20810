"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from meterloom.plans.catalog import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(v):
    if v is None:
        return ""
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return f"{float(v) + 0.0:.5f}"
    return str(v)


def rows_of(columns, rows):
    order = sorted(columns)
    return sorted(tuple(plain(r[columns.index(c)]) for c in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf, name):
    frame = QUERIES[name](spark, sf)
    got = frame.collect()
    if name not in SQL:
        return
    r = duck.sql(SQL[name])
    assert sorted(frame.columns) == sorted(r.columns)
    assert rows_of(frame.columns, got) == rows_of(r.columns, r.fetchall())
