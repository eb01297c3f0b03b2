"""Each query against its SQL in DuckDB; queries without SQL give rows."""

from __future__ import annotations

import pytest

from tarn.plans.catalog import ORACLES, QUERIES

from .conftest import DATA_001, rows_of


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA_001)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert got[1], "no rows"
    if name in ORACLES:
        q = duck.sql(ORACLES[name])
        assert got == rows_of(q.columns, q.fetchall())


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
