"""Customer rollups and nested sale items."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from henhouse.functions import exprs as X
from henhouse.functions import filters as P
from henhouse.sources.tables import Tables

ITEM_FIELDS = ["product_type", "category", "quantity", "eggs_per_unit", "unit_price", "line_total"]


def eggs_per_sale(items: DataFrame, nested: bool = False) -> DataFrame:
    """Items pre-aggregated per sale (joins then cannot fan out sale totals); ``nested``
    adds the items themselves as an ordered array."""
    more = [F.array_sort(F.collect_list(F.struct(*ITEM_FIELDS))).alias("items")] if nested else []
    return items.groupBy("sale_id").agg(
        F.sum(X.line_eggs("quantity", "eggs_per_unit")).alias("eggs"),
        F.count(F.lit(1)).alias("n_items"), *more)


def items_text(items) -> F.Column:
    """The items of a sale in one line: product:category:quantity:price:total; ..."""
    return F.concat_ws(";", F.transform(items, lambda i: F.concat_ws(
        ":", *[i[f].cast("string") for f in ("product_type", "category", "quantity", "unit_price", "line_total")])))


def customer_rollup(t: Tables) -> DataFrame:
    """Per normalised customer (NULL = no customer is one group): sale count, Σ
    total, Σ eggs and last sale date, ordered by total then last sale.

    The hot NULL group costs nothing extra: partial aggregation leaves one row per
    group per map task before the shuffle."""
    s = t.sales.filter(P.active_only()).select(
        "id", X.normalise_customer("customer").alias("customer"), "total", "sale_date")
    e = eggs_per_sale(t.sale_items)
    j = s.join(e, s.id == e.sale_id, "left")
    return (j.groupBy("customer").agg(
        F.count(F.lit(1)).cast("bigint").alias("sales"),
        F.coalesce(F.sum("total"), F.lit(0)).cast("double").alias("total"),
        F.coalesce(F.sum("eggs"), F.lit(0)).cast("bigint").alias("eggs"),
        F.max("sale_date").alias("last_sale"))
        .orderBy(F.col("total").desc(), F.col("last_sale").desc_nulls_first(),
                 F.col("customer").asc_nulls_first()))


def customer_sales(t: Tables, customer: str | None = None, all_customers: bool = True,
                   k: int = 200) -> DataFrame:
    """Latest ``k`` active sales per normalised customer with author, eggs and items.

    With ``all_customers`` every customer's list is built in one job (per-group
    top-k with a partial WindowGroupLimit before the shuffle); otherwise only the
    customer given (blank or None = the no-customer group) is filtered."""
    s = t.sales.filter(P.active_only())
    if not all_customers:
        s = s.filter(P.by_customer("customer", customer))
    s = s.withColumn("customer_key", X.normalise_customer("customer"))
    w = Window.partitionBy("customer_key").orderBy(
        F.col("sale_date").desc(), F.col("created_at").desc(), F.col("id").desc())
    top = s.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k)
    return _with_items_and_author(t, top.select(
        "customer_key", "id", "sale_date", "customer", "total", "created_at", "created_by", "rn"))


def _with_items_and_author(t: Tables, top: DataFrame) -> DataFrame:
    """The capped list is computed once; the items are aggregated per sale beforehand, so
    one join brings eggs, count and items."""
    e = eggs_per_sale(t.sale_items, nested=True)
    u = t.users.select(F.col("id").alias("uid"), F.col("name").alias("actor_name"))
    j = top.join(e, top.id == e.sale_id, "left").join(u, top.created_by == u.uid, "left")
    return j.select(
        *[c for c in top.columns if c != "created_by"], "actor_name",
        F.coalesce("eggs", F.lit(0)).cast("bigint").alias("eggs"),
        F.coalesce("n_items", F.lit(0)).cast("bigint").alias("n_items"), "items")


def sale_items_nested(t: Tables) -> DataFrame:
    """Per sale: its items as an ordered array of structs (childless sales get an
    empty array) and Σ eggs. No item id exists, so items are ordered by all their
    fields (the driver data repeats (order, line) pairs)."""
    it = t.sale_items
    nested = it.groupBy("sale_id").agg(
        F.array_sort(F.collect_list(F.struct(*ITEM_FIELDS))).alias("items"),
        F.sum(X.line_eggs("quantity", "eggs_per_unit")).alias("eggs"))
    s = t.sales.select("id")
    return (s.join(nested, s.id == nested.sale_id, "left")
            .select(F.col("id").alias("sale_id"),
                    F.coalesce("items", F.array().cast("array<struct<product_type:string,category:string,"
                                                        "quantity:int,eggs_per_unit:int,unit_price:decimal(12,2),"
                                                        "line_total:decimal(12,2)>>")).alias("items"),
                    F.coalesce("eggs", F.lit(0)).cast("bigint").alias("eggs")))


def flatten_items(nested: DataFrame) -> DataFrame:
    """One row per (sale, position) — the comparable form of the nested items."""
    return nested.select("sale_id", "eggs", F.posexplode_outer("items").alias("pos", "item")).select(
        "sale_id", "eggs", "pos", *[F.col(f"item.{f}").alias(f) for f in ITEM_FIELDS])


def customer_ranking(t: Tables) -> DataFrame:
    """Customers ranked by total, then last sale (NULL customer first on ties): the
    rollup under a range-partitioned global sort — no single-partition window, so
    the ranking scales with the number of customers."""
    return customer_rollup(t)
