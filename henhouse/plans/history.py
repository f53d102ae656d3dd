"""Histories, by-date lists, the merged activity feed and plain lists
(SURVEY §2.7, §2.8). Histories keep voided rows; the feed drops them.

Capped lists are ``orderBy(...).limit(k)`` — TakeOrderedAndProject keeps k rows per
task and merges them — and the author / shed names are joined *after* the cap, to
k rows instead of the whole table. Every order ends with the id, so a cap selects a
deterministic set."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from henhouse.functions import exprs as X
from henhouse.functions import filters as P
from henhouse.plans.customers import eggs_per_sale
from henhouse.sources.tables import Tables


def with_author(t: Tables, df: DataFrame, col: str = "created_by", name: str = "actor_name") -> DataFrame:
    """Left join to users for the author's name (authors may be missing)."""
    u = t.users.select(F.col("id").alias("__uid"), F.col("name").alias(name))
    return df.join(u, F.col(col) == F.col("__uid"), "left").drop("__uid")


def with_shed(t: Tables, df: DataFrame, col: str = "galpon_id", name: str = "galpon_name") -> DataFrame:
    g = t.galpones.select(F.col("id").alias("__gid"), F.col("name").alias(name))
    return df.join(g, F.col(col) == F.col("__gid"), "left").drop("__gid")


def _recent(df: DataFrame, date_col: str, k: int) -> DataFrame:
    """The rows of the latest days that together hold ``k`` rows: an exact cut for a list
    of the k newest. The rows are counted per day (of a table stored by day that reads
    no column), and the day at which the running count reaches k is a scalar subquery,
    so the list itself reads the folders from that day on."""
    days = df.groupBy(date_col).agg(F.count(F.lit(1)).alias("n"))
    upto = Window.orderBy(F.col(date_col).desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reached = days.withColumn("n", F.sum("n").over(upto)).filter(F.col("n") >= k)
    first = days.agg(F.min(date_col).alias("d")).scalar()
    return df.filter(F.col(date_col) >= F.coalesce(reached.agg(F.max(date_col).alias("d")).scalar(), first))


def _newest(df: DataFrame, date_col: str) -> DataFrame:
    """The order of a capped list, stated again after the joins of names."""
    return df.orderBy(F.col(date_col).desc(), F.col("created_at").desc(), F.col("id").desc())


def collection_history(t: Tables, k: int = 500) -> DataFrame:
    dc = _recent(t.daily_collections, "collection_date", k)
    top = dc.orderBy(F.col("collection_date").desc(), F.col("created_at").desc(), F.col("id").desc()).limit(k)
    top = top.withColumn("eggs", X.total_eggs().cast("bigint"))
    return _newest(with_shed(t, with_author(t, top)), "collection_date")


def sales_history(t: Tables, k: int = 500) -> DataFrame:
    """Latest sales (voided kept) with author, item count, eggs and the items."""
    top = _recent(t.sales, "sale_date", k).orderBy(F.col("sale_date").desc(), F.col("created_at").desc(), F.col("id").desc()).limit(k)
    items = t.sale_items.join(F.broadcast(top.select(F.col("id").alias("sale_id"))), "sale_id", "left_semi")
    e = eggs_per_sale(items, nested=True)
    j = with_author(t, top).join(e, F.col("id") == e.sale_id, "left").drop("sale_id")
    return _newest(j.withColumn("eggs", F.coalesce("eggs", F.lit(0)).cast("bigint"))
                   .withColumn("n_items", F.coalesce("n_items", F.lit(0)).cast("bigint")), "sale_date")


def expense_history(t: Tables, k: int = 500) -> DataFrame:
    top = _recent(t.expenses, "expense_date", k).orderBy(F.col("expense_date").desc(), F.col("created_at").desc(), F.col("id").desc()).limit(k)
    return _newest(with_shed(t, with_author(t, top)), "expense_date")


def collections_on(t: Tables, as_of) -> DataFrame:
    """All collections of one date, voided ones included, newest first."""
    return t.daily_collections.filter(P.on_date("collection_date", as_of)) \
        .orderBy(F.col("created_at").desc(), F.col("id").desc())


def sales_on(t: Tables, as_of) -> DataFrame:
    return t.sales.filter(P.on_date("sale_date", as_of)).orderBy(F.col("created_at").desc(), F.col("id").desc())


def expenses_on(t: Tables, as_of) -> DataFrame:
    return t.expenses.filter(P.on_date("expense_date", as_of)) \
        .orderBy(F.col("created_at").desc(), F.col("id").desc())


def feed_union(t: Tables) -> DataFrame:
    """Active collections, sales and expenses as one record stream with a type tag
    (NULL where a kind has no eggs / amount / shed)."""
    null_l = F.lit(None).cast("bigint")
    null_m = F.lit(None).cast("decimal(12,2)")
    dc = t.daily_collections.filter(P.active_only()).select(
        F.lit("collection").alias("type"), F.col("id").cast("string").alias("record_id"), "created_at",
        "created_by", "galpon_id", X.total_eggs().cast("bigint").alias("eggs"), null_m.alias("amount"))
    s = t.sales.filter(P.active_only()).select(
        F.lit("sale").alias("type"), F.col("id").cast("string").alias("record_id"), "created_at",
        "created_by", null_l.alias("galpon_id"), null_l.alias("eggs"), F.col("total").alias("amount"))
    e = t.expenses.filter(P.active_only()).select(
        F.lit("expense").alias("type"), F.col("id").cast("string").alias("record_id"), "created_at",
        "created_by", "galpon_id", null_l.alias("eggs"), F.col("amount"))
    return dc.unionByName(s).unionByName(e)


def feed_order():
    return [F.col("created_at").desc(), F.col("type").asc(), F.col("record_id").desc()]


def _named(t: Tables, df: DataFrame) -> DataFrame:
    return with_shed(t, with_author(t, df)).drop("created_by", "galpon_id")


def activity_feed(t: Tables, k: int = 30) -> DataFrame:
    """Admin view: the k latest active records of any kind with names."""
    return _named(t, feed_union(t).orderBy(*feed_order()).limit(k))


def role_visibility(t: Tables, k: int = 30) -> DataFrame:
    """The feed each role sees, for every user at once: admins share the merged
    feed (viewer 'admin'); each worker sees only their own collections (per-author
    top-k, limited before the shuffle)."""
    admin = activity_feed(t, k).withColumn("viewer", F.lit("admin"))
    workers = t.users.filter(F.col("role") == "trabajador").select(F.col("id").alias("__w"))
    own = feed_union(t).filter(F.col("type") == "collection")
    own = own.join(workers, own.created_by == workers["__w"], "left_semi")
    w = Window.partitionBy("created_by").orderBy(*feed_order())
    own = own.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k).drop("rn")
    own = own.withColumn("viewer", F.col("created_by").cast("string"))
    return admin.unionByName(_named(t, own))


def user_list(t: Tables) -> DataFrame:
    return t.users.select("id", "name", "role", "active", X.label("role", "role").alias("role_label")) \
        .orderBy(F.col("active").desc(), F.col("name").asc(), F.col("id").asc())
