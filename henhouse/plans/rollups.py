"""Customer and month rollups that are kept up to date.

A stored table holds one row per (month, customer): sales, money, eggs and the last sale
date. What a screen shows is a sum over its rows, and the last sale date a maximum, which
can't be taken back from a sum but is simply made again with its month. A new sale, a void
or an edit changes the rows of its month only: ``refresh`` reads the facts of the touched
months and replaces their rows, all in the buckets those months lie in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from henhouse.functions import exprs as X
from henhouse.functions import filters as P
from henhouse.plans.customers import eggs_per_sale
from henhouse.sources.keyed import KeyedTable
from henhouse.sources.tables import Tables

KEY = ["month", "customer"]
#: How a sale without a customer is stored; a name is never empty.
NOBODY = ""
BUCKETS = 64


def partial_rows(t: Tables, keep: Callable[[str], F.Column] | None = None) -> DataFrame:
    """One row per (month, customer) of the sales whose date passes ``keep``."""
    sales, items = t.sales.filter(P.active_only()), t.sale_items
    if keep is not None:
        sales, items = sales.filter(keep("sale_date")), t.items_between(keep)
    s = sales.select("id", F.trunc("sale_date", "MM").alias("month"), "sale_date", "total",
                     F.coalesce(X.normalise_customer("customer"), F.lit(NOBODY)).alias("customer"))
    e = eggs_per_sale(items)
    return (s.join(e, s.id == e.sale_id, "left").groupBy(*KEY).agg(
        F.count(F.lit(1)).cast("bigint").alias("sales"), F.sum("total").cast("decimal(22,2)").alias("total"),
        F.coalesce(F.sum("eggs"), F.lit(0)).cast("bigint").alias("eggs"), F.max("sale_date").alias("last_sale"))
        .filter("month IS NOT NULL"))


class SalesRollup:
    def __init__(self, spark: SparkSession, root: str):
        self.table = KeyedTable(spark, root)

    @classmethod
    def create(cls, t: Tables, root: str) -> SalesRollup:
        KeyedTable.create(t.spark, root, partial_rows(t), KEY, BUCKETS, dealt_by=["month"])
        return cls(t.spark, root)

    def refresh(self, t: Tables, changed: DataFrame, writer: str | None = None, epoch: int | None = None) -> dict:
        """Makes the months of ``changed`` (column ``date``: the sale dates before and after
        each change) again from the facts as they are now."""
        months = changed.select(F.trunc("date", "MM").alias("month")).filter("month IS NOT NULL").distinct()
        named = sorted(r[0] for r in months.collect())  # bounded by the calendar
        if not named:
            return self.table.manifest()

        def keep(c: str) -> F.Column:
            """In one of the months, and between the first and the last: that prunes folders."""
            inside = F.trunc(c, "MM").isin(named)
            return (F.col(c) >= F.lit(named[0])) & (F.col(c) <= F.last_day(F.lit(named[-1]))) & inside

        return self.table.replace(partial_rows(t, keep), months, writer, epoch)

    def customers(self) -> DataFrame:
        """Like ``customers.customer_rollup``."""
        return (self.table.read().groupBy("customer").agg(
            F.sum("sales").alias("sales"), F.coalesce(F.sum("total"), F.lit(0)).cast("double").alias("total"),
            F.sum("eggs").alias("eggs"), F.max("last_sale").alias("last_sale"))
            .withColumn("customer", F.when(F.col("customer") != NOBODY, F.col("customer")))
            .orderBy(F.col("total").desc(), F.col("last_sale").desc_nulls_first(), F.col("customer").asc_nulls_first()))

    def months(self) -> DataFrame:
        """Money per month of the active sales: d, total."""
        return self.table.read().groupBy(F.col("month").alias("d")).agg(F.sum("total").cast("double").alias("total"))
