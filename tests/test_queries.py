"""Every query with an SQL counterpart gives its rows, at the smallest scale."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal | int):
        return float(v) if abs(v) < 1 << 53 else int(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 7) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return c


@pytest.mark.parametrize("key", [k for k in entry.queries() if k in entry.oracle_sql()])
def test_query(spark, db, key):
    df = entry.queries()[key](spark, SF)
    r = db.execute(entry.oracle_sql()[key])
    names = [d[0] for d in r.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(([norm(x[names.index(n)]) for n in sorted(names)] for x in r.fetchall()), key=repr)
    assert sorted(([norm(x[n]) for n in sorted(names)] for x in df.collect()), key=repr) == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_other_queries_run(spark):
    for k in ("fn_digest_more", "fn_session"):
        assert entry.queries()[k](spark, SF).count() > 0
