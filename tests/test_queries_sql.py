"""Every query of the core against its SQL on the smallest tables, and the driver contract."""

import decimal
import os

import duckdb
import pytest

import __spark_entry__ as entry
from rectifold.plans import reference, training

DIR = "/root/testdata/sf0.001"
SQL = reference.oracle_sql() | training.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="the test tables are not here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DIR):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{DIR}/{f}{'/*' if os.path.isdir(os.path.join(DIR, f)) else ''}')")
    return c


def norm(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return float(v) if isinstance(v, int) and not isinstance(v, bool) else v


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    df = (reference.queries() | training.queries())[name](spark, DIR)
    cols = sorted(df.columns)
    r = duck.execute(SQL[name])
    at = [x[0] for x in r.description]
    assert sorted(at) == cols
    want = ordered([tuple(norm(x[at.index(c)]) for c in cols) for x in r.fetchall()])
    assert ordered([tuple(norm(x[c]) for c in cols) for x in df.collect()]) == want


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).limit(1).count() == 1
