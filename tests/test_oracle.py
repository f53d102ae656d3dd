"""Every registered farm query against its DuckDB oracle (sf0.001), as the round driver
does at sf0.01; queries without an oracle must at least run."""

import datetime as dt
import decimal
import math
import os

import duckdb
import pytest

import __spark_entry__ as E
from henhouse import catalog

SF = "/root/testdata/sf0.001"
RAW = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


def _norm(v):
    if v is None:
        return "∅"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, decimal.Decimal):
        return f"{float(v):.9g}"
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    return str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for r in RAW:
        c.execute(f"CREATE VIEW {r} AS SELECT * FROM read_parquet('{os.path.join(SF, r + '.parquet')}')")
    return c


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["label", "date", "eggs", "sales", "expenses", "profit"]
    assert df.count() == 7


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    cols = df.columns
    rows = df.collect()
    sql = E.oracle_sql().get(name)
    if sql is None:
        return
    cur = con.execute(sql)
    ocols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(ocols)
    orows = cur.fetchall()
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    oorder = [ocols.index(cols[i]) for i in order]
    a = sorted(tuple(_norm(r[i]) for i in order) for r in rows)
    b = sorted(tuple(_norm(r[i]) for i in oorder) for r in orows)
    assert a == b
