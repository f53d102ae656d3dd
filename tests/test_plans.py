"""Physical plan checks: filters reach the scan, no cartesian products or
nested-loop joins on the fact tables, per-group top-k limited before the shuffle."""

import io
from contextlib import redirect_stdout

import pytest

from henhouse import catalog


def _plan(df) -> str:
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


@pytest.mark.parametrize("name", ["report_series", "calendar_join", "dashboard_today", "customer_rollup",
                                  "customer_sales", "shed_daily", "activity_feed", "stock_apply_sale",
                                  "stock_void_collection", "unread_count", "sync_ops"])
def test_no_cartesian(spark, name):
    p = _plan(catalog.queries()[name](spark, "/root/testdata/sf0.001"))
    assert "CartesianProduct" not in p
    assert "BroadcastNestedLoopJoin" not in p


def test_report_pushes_filters(spark):
    """The 7-day window reaches the parquet scans through the adapter's aggregate
    and casts as timestamp ranges, and only the needed columns are read."""
    p = _plan(catalog.queries()["report_series"](spark, "/root/testdata/sf0.001"))
    assert "GreaterThanOrEqual(l_shipdate,2001-07-09T00:00)" in p
    assert "LessThan(l_shipdate,2001-07-16T00:00)" in p
    assert "GreaterThanOrEqual(o_orderdate,2001-07-09T00:00)" in p
    assert "ReadSchema: struct<l_partkey:bigint,l_suppkey:bigint,l_quantity:double,l_shipdate:timestamp_ntz>" in p


def test_customer_sales_limits_before_shuffle(spark):
    p = _plan(catalog.queries()["customer_sales"](spark, "/root/testdata/sf0.001"))
    assert "WindowGroupLimit" in p


def test_histories_take_ordered(spark):
    p = _plan(catalog.queries()["collection_history"](spark, "/root/testdata/sf0.001"))
    assert "TakeOrderedAndProject" in p
