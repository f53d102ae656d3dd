"""Shed (galpon) overview and history, computed for every shed in one job
(SURVEY §3.3): a single shed is then just a pushed-down filter on the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from henhouse.functions import exprs as X
from henhouse.functions import filters as P
from henhouse.plans.calendar import day_sequence, month_sequence
from henhouse.sources.tables import Tables


def shed_today(t: Tables, as_of) -> DataFrame:
    """Eggs and broken eggs per shed on as_of (collections without shed form their
    own NULL group, as in the reference's sub-query)."""
    return (t.daily_collections
            .filter(P.on_date("collection_date", as_of) & P.active_only())
            .groupBy("galpon_id")
            .agg(F.sum(X.total_eggs()).alias("eggs"), F.sum("rotos").cast("bigint").alias("rotos")))


def shed_overview(t: Tables, as_of) -> DataFrame:
    """All sheds (inactive too) with today's eggs, broken eggs and laying rate,
    ordered active first, then by name (id breaks name ties)."""
    today = shed_today(t, as_of).filter(F.col("galpon_id").isNotNull())
    g = t.galpones
    j = g.join(today, g.id == today.galpon_id, "left")
    return (j.select(
        g.id, g.name, g.bird_count, g.active,
        F.coalesce(today.eggs, F.lit(0)).cast("bigint").alias("eggs_today"),
        F.coalesce(today.rotos, F.lit(0)).cast("bigint").alias("rotos_today"),
    ).withColumn("laying_rate", X.laying_rate("eggs_today", "bird_count"))
        .orderBy(F.col("active").desc(), F.col("name").asc(), F.col("id").asc()))


def shed_series(t: Tables, period: int, as_of) -> DataFrame:
    """Zero-filled eggs / broken series for every shed: days for 7 and 30, months
    for 365. The zero rows come from a per-shed generator (no cross join); a group
    is kept only if its shed exists (flag carried by the zero rows)."""
    d0 = X.lit_date(as_of)
    if period == 365:
        lo = F.add_months(F.trunc(d0, "MM"), -11)
        spine = month_sequence(lo, F.trunc(d0, "MM"))
        keep = P.months_bounded("collection_date", as_of)
        bucket = F.trunc("collection_date", "MM")
        label = X.month_label
    else:
        spine = day_sequence(F.date_sub(d0, period - 1), d0)
        keep = P.window_bounded("collection_date", as_of, period)
        bucket = F.col("collection_date")
        label = X.day_label
    zeros = t.galpones.select(
        F.col("id").alias("galpon_id"), F.explode(spine).alias("d"),
        F.lit(0).cast("bigint").alias("eggs"), F.lit(0).cast("bigint").alias("rotos"),
        F.lit(1).alias("known"))
    facts = (t.daily_collections
             .filter(keep & P.active_only() & F.col("galpon_id").isNotNull())
             .select("galpon_id", bucket.alias("d"), X.total_eggs().cast("bigint").alias("eggs"),
                     F.col("rotos").cast("bigint").alias("rotos"), F.lit(0).alias("known")))
    agg = (zeros.unionByName(facts).groupBy("galpon_id", "d")
           .agg(F.sum("eggs").alias("eggs"), F.sum("rotos").alias("rotos"), F.max("known").alias("known")))
    return agg.filter(F.col("known") == 1).select(
        "galpon_id", label("d").alias("label"), F.col("d").alias("date"), "eggs", "rotos").orderBy("galpon_id", "date")


def shed_totals(t: Tables, period: int, as_of) -> DataFrame:
    """Eggs and broken eggs per shed in the trailing window (no upper bound), with
    the break rate; sheds without collections report zeros."""
    agg = (t.daily_collections
           .filter(P.trailing_window("collection_date", as_of, period) & P.active_only())
           .groupBy("galpon_id")
           .agg(F.sum(X.total_eggs()).alias("eggs"), F.sum("rotos").alias("rotos")))
    g = t.galpones.select("id")
    j = g.join(agg, g.id == agg.galpon_id, "left").select(
        F.col("id").alias("galpon_id"),
        F.coalesce("eggs", F.lit(0)).cast("bigint").alias("eggs"),
        F.coalesce("rotos", F.lit(0)).cast("bigint").alias("rotos"))
    return j.withColumn("break_rate", X.break_rate("rotos", "eggs"))


def net_birds(t: Tables, period: int, as_of) -> DataFrame:
    """Σ signed bird changes per shed in the trailing window (active events)."""
    return (t.bird_events
            .filter(P.trailing_window("event_date", as_of, period) & P.active_only())
            .groupBy("galpon_id").agg(F.sum("delta").cast("bigint").alias("net")))


def _top_per_shed(df: DataFrame, order, k: int) -> DataFrame:
    """Per-shed top-k: row_number over the shed; Spark inserts a partial
    WindowGroupLimit before the shuffle, so a busy shed ships at most k rows per
    map task."""
    w = Window.partitionBy("galpon_id").orderBy(*order)
    return df.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k)


def shed_bird_ledger(t: Tables, k: int = 100) -> DataFrame:
    """Latest active bird events of every shed (not limited to a period)."""
    ev = t.bird_events.filter(P.active_only())
    return _top_per_shed(
        ev.select("id", "galpon_id", "event_date", "type", "delta", "created_at"),
        [F.col("event_date").desc(), F.col("created_at").desc(), F.col("id").desc()], k)


def shed_collections(t: Tables, period: int, as_of, k: int = 100) -> DataFrame:
    """Latest active collections of every shed in the window, with author name."""
    dc = t.daily_collections.filter(
        P.trailing_window("collection_date", as_of, period) & P.active_only() & F.col("galpon_id").isNotNull())
    top = _top_per_shed(
        dc.select("id", "galpon_id", "collection_date", "pequeno", "mediano", "grande", "extra_grande",
                  "jumbo", "rotos", X.total_eggs().cast("bigint").alias("eggs"), "created_at", "created_by"),
        [F.col("collection_date").desc(), F.col("created_at").desc(), F.col("id").desc()], k)
    u = t.users.select(F.col("id").alias("uid"), F.col("name").alias("actor_name"))
    return top.join(u, top.created_by == u.uid, "left").drop("uid", "created_by")


def bird_reconcile(t: Tables) -> DataFrame:
    """Audit: stored bird_count against Σ active deltas; sheds created with a
    count have no opening event, so opening = count - Σ deltas."""
    s = (t.bird_events.filter(P.active_only()).groupBy("galpon_id")
         .agg(F.sum("delta").cast("bigint").alias("sum_delta"), F.count(F.lit(1)).alias("events")))
    g = t.galpones
    return (g.join(s, g.id == s.galpon_id, "left")
            .select(g.id.alias("galpon_id"), g.bird_count.cast("bigint").alias("bird_count"),
                    F.coalesce("sum_delta", F.lit(0)).cast("bigint").alias("sum_delta"),
                    F.coalesce("events", F.lit(0)).cast("bigint").alias("events"))
            .withColumn("opening", F.col("bird_count") - F.col("sum_delta")))


def shed_header(t: Tables, period: int, as_of, bird_as_of=None) -> DataFrame:
    """Header of the shed history screen for every shed: totals in the window,
    net birds, break rate and current bird count."""
    tot = shed_totals(t, period, as_of)
    nb = net_birds(t, period, bird_as_of or as_of).withColumnRenamed("galpon_id", "nb_id")
    g = t.galpones.select("id", "name", "bird_count", "active")
    j = g.join(tot, g.id == tot.galpon_id, "left").join(nb, g.id == nb.nb_id, "left")
    return j.select("id", "name", "bird_count", "active", "eggs", "rotos", "break_rate",
                    F.coalesce("net", F.lit(0)).cast("bigint").alias("net_birds"))


def shed_history(t: Tables, period: int, as_of, bird_as_of=None, k: int = 100) -> DataFrame:
    """The whole history screen of every shed, one row per entry: ``part`` is header, series,
    event or collection, ``pos`` the place inside the part (points in time order, the k
    newest events and collections). One shed is a filter on ``shed``."""
    null = {"name": "string", "active": "boolean", "bird_count": "int", "entry": "string", "label": "string", "date": "date", "kind": "string",
            "eggs": "bigint", "rotos": "bigint", "delta": "bigint", "break_rate": "double", "net_birds": "bigint", "actor_name": "string"}

    def rows(df, part, shed, pos, **given):
        return df.select(F.col(shed).alias("shed"), F.lit(part).alias("part"), pos.cast("int").alias("pos"),
                         *[given.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in null.items()])

    own = lambda *cols: {c: F.col(c) for c in cols}
    head = rows(shed_header(t, period, as_of, bird_as_of), "header", "id", F.lit(1),
                **own("name", "active", "bird_count", "eggs", "rotos", "break_rate", "net_birds"))
    place = F.row_number().over(Window.partitionBy("galpon_id").orderBy("date"))
    series = rows(shed_series(t, period, as_of), "series", "galpon_id", place, **own("label", "date", "eggs", "rotos"))
    known = lambda df: P.in_keys(df, "galpon_id", t.galpones)
    events = rows(known(shed_bird_ledger(t, k)), "event", "galpon_id", F.col("rn"), entry=F.col("id"), date=F.col("event_date"), kind=F.col("type"),
                  delta=F.col("delta"))
    made = rows(known(shed_collections(t, period, as_of, k)), "collection", "galpon_id", F.col("rn"), entry=F.col("id"), date=F.col("collection_date"),
                **own("eggs", "rotos", "actor_name"))
    return head.unionByName(series).unionByName(events).unionByName(made).orderBy("shed", "part", "pos")


def shed_list(t: Tables, include_inactive: bool = False) -> DataFrame:
    g = t.galpones if include_inactive else P.active_sheds(t.galpones)
    return g.select("id", "name", "bird_count", "active").orderBy("name", "id")
