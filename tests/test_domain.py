"""Stored domain tables: write_domain -> Tables.from_domain gives the same results
as the adapter path, with filters reaching the scan."""

import io
import os
import re
import tempfile
from contextlib import redirect_stdout

from henhouse.plans import customers as CU
from henhouse.plans import history as H
from henhouse.plans import reports as R
from henhouse.sources.tables import Tables, write_domain


def _rows(df):
    return sorted(tuple(str(v) for v in r) for r in df.collect())


def test_domain_round_trip(spark, tables_small):
    root = os.path.join(tempfile.mkdtemp(prefix="henhouse-domain-"), "db")
    write_domain(tables_small, root)
    stored = Tables.from_domain(spark, root)
    assert stored.daily_collections.columns == tables_small.daily_collections.columns
    for fn in (lambda t: R.report_series(t, 30, "2001-07-15"), lambda t: R.dashboard_today(t, "2001-07-15"),
               CU.customer_rollup, lambda t: R.sales_by_category(t, 365, "2001-07-15")):
        assert _rows(fn(stored)) == _rows(fn(tables_small))
    buf = io.StringIO()
    with redirect_stdout(buf):
        R.report_series(stored, 7, "2001-07-15").explain("formatted")
    plan = buf.getvalue()
    # the date predicate prunes partition folders
    assert "PartitionFilters: [isnotnull(collection_date" in plan
    # the capped history reads the folders from its cut-off day on, and is the same list
    for fn, k in ((H.collection_history, 60), (H.sales_history, 40), (H.expense_history, 100_000)):
        assert [str(r.id) for r in fn(stored, k).collect()] == [str(r.id) for r in fn(tables_small, k).collect()]
    buf = io.StringIO()
    with redirect_stdout(buf):
        H.collection_history(stored, 60).explain("formatted")
    assert re.search(r"PartitionFilters: \[.*collection_date#\d+ >= coalesce\(.*[sS]ubquery", buf.getvalue())
