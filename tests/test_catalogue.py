"""Every registered query runs, and agrees with its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as contract
from catalog import oracle, queries
from tools.check import TABLES, rows_of

def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", list(queries.queries()))
def test_query_agrees_with_sql(spark, sf, name):
    found = queries.queries()[name](spark, sf)
    if name not in oracle.oracle_sql():
        assert found.collect()
        return
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    result = db.execute(oracle.oracle_sql()[name])
    expected = rows_of([d[0] for d in result.description], result.fetchall())
    assert rows_of(found.columns, found.collect()) == expected


def test_entry(spark):
    rows = contract.entry(spark).collect()
    assert len(rows) == 9
