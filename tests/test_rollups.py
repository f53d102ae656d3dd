"""Rollups kept up to date, and items stored beside their sales."""

import os
import tempfile

from pyspark.sql import functions as F

from henhouse.plans import customers as CU
from henhouse.plans import reports as R
from henhouse.plans import rollups as RU
from henhouse.sources.tables import Tables, write_domain


def _rows(df):
    return sorted(tuple(str(v) for v in r) for r in df.collect())


def _with_sales(t, sales):
    return Tables(t.spark, lambda _, name: sales if name == "sales" else t.table(name))


def test_a_void_remakes_its_month_only(spark, tables_small):
    root = os.path.join(tempfile.mkdtemp(prefix="henhouse-rollup-"), "r")
    rollup = RU.SalesRollup.create(tables_small, root)
    assert _rows(rollup.customers()) == _rows(CU.customer_rollup(tables_small))
    # the newest sale of a customer is voided: the last sale date goes back
    hit = tables_small.sales.filter("voided_at IS NULL AND trim(customer) <> ''").orderBy(F.col("sale_date").desc(), "id").first()
    sales = tables_small.sales.withColumn("voided_at", F.when(F.col("id") == hit.id, F.col("created_at")).otherwise(F.col("voided_at")))
    now = _with_sales(tables_small, sales)
    before = rollup.table.manifest()
    changed = rollup.refresh(now, spark.createDataFrame([(hit.sale_date,)], "date date"), writer="voids", epoch=1)
    assert len(changed["rewritten"]) == 1
    assert sum(changed["files"][b] != before["files"].get(b) for b in changed["files"]) <= 1
    assert _rows(rollup.customers()) == _rows(CU.customer_rollup(now))
    assert rollup.refresh(now, spark.createDataFrame([(hit.sale_date,)], "date date"), writer="voids", epoch=1)["version"] == changed["version"]


def test_an_edited_date_moves_between_months_and_a_month_can_empty(spark, tables_small):
    root = os.path.join(tempfile.mkdtemp(prefix="henhouse-rollup-"), "r")
    rollup = RU.SalesRollup.create(tables_small, root)
    month = F.trunc("sale_date", "MM") == F.lit("1995-03-01").cast("date")
    sales = tables_small.sales.withColumn("sale_date", F.when(month, F.lit("1995-05-09").cast("date")).otherwise(F.col("sale_date")))
    now = _with_sales(tables_small, sales)
    rollup.refresh(now, spark.createDataFrame([("1995-03-20",), ("1995-05-09",)], "d string").select(F.to_date("d").alias("date")))
    assert _rows(rollup.customers()) == _rows(CU.customer_rollup(now))
    assert rollup.months().filter("d = '1995-03-01'").count() == 0
    rollup.refresh(now, spark.createDataFrame([], "date date"))
    assert _rows(rollup.customers()) == _rows(CU.customer_rollup(now))


def test_items_lie_beside_their_sales(spark, tables_small):
    root = os.path.join(tempfile.mkdtemp(prefix="henhouse-items-"), "db")
    write_domain(tables_small, root)
    stored = Tables.from_domain(spark, root)
    assert stored.sale_items.columns == tables_small.sale_items.columns
    assert _rows(stored.sale_items) == _rows(tables_small.sale_items)
    for as_of in ("1996-08-15", "2001-07-15"):
        assert _rows(R.sales_by_category(stored, 30, as_of)) == _rows(R.sales_by_category(tables_small, 30, as_of))
        assert _rows(R.report(stored, as_of)) == _rows(R.report(tables_small, as_of))
    plan = R.sales_by_category(stored, 30, "1996-08-15")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [isnotnull(sale_date") == 2
