from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tarn.session import session  # noqa: E402

DATA = "/root/testdata/sf0.001"
DATA_001 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = session(os.environ.get("TARN_TEST_MASTER", "local[8]"), shuffle_partitions=8, memory="6g")
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA_001}/{t}.parquet'")
    return con


def shown(v):
    """A value as comparable text."""
    import datetime
    import decimal

    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float | decimal.Decimal):
        return f"{float(v):.6g}"
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    if isinstance(v, list | tuple):
        return str([shown(x) for x in v])
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted(tuple(shown(r[k]) for k in order) for r in rows)
