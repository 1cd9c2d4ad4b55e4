"""Every registered query that has SQL, against DuckDB on the smallest tables."""

import math
import os
from pathlib import Path

import duckdb
import pytest

from colonnade.plans import columnar, readings

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = readings.QUERIES | columnar.QUERIES, readings.ORACLES | columnar.ORACLES

pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(DATA).iterdir():
        c.sql(f"CREATE VIEW {p.name.split('.')[0]} AS SELECT * FROM '{p}'")
    return c


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "null"
    return repr(float(x)) if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    ours = QUERIES[name](spark, DATA)
    columns = sorted(ours.columns)
    theirs = duck.sql(ORACLES[name])
    assert sorted(theirs.columns) == columns
    a = sorted(tuple(plain(r[c]) for c in columns) for r in ours.collect())
    at = [theirs.columns.index(c) for c in columns]
    b = sorted(tuple(plain(r[i]) for i in at) for r in theirs.fetchall())
    assert a == b


def test_every_query_is_registered():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())
