"""Reports and the day summary.

Plan shape of a series: the three fact tables are filtered at the scan, projected to
a common narrow row (bucket, eggs, sales, expenses), unioned with the zero rows of
the calendar and aggregated once. That is one shuffle for the whole report (map-side
partial aggregation leaves at most one row per bucket per task), no join, and the
zero-fill is a by-product of the union instead of a calendar left join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from henhouse import schemas
from henhouse.functions import exprs as X
from henhouse.functions import filters as P
from henhouse.plans.calendar import calendar_days, calendar_months
from henhouse.sources.tables import Tables

def _zero_money():
    return F.lit(0).cast(schemas.MONEY)


def _grain(period: int) -> str:
    if period not in schemas.PERIODS:
        raise ValueError(f"period must be one of {schemas.PERIODS}")
    return "month" if period == 365 else "day"


# -- single-table aggregates ---------------------------------------------------
def daily_production(t: Tables, as_of, period: int) -> DataFrame:
    """Eggs per collection date in the trailing window (no upper bound)."""
    return (t.daily_collections
            .filter(P.trailing_window("collection_date", as_of, period) & P.active_only())
            .groupBy(F.col("collection_date").alias("d"))
            .agg(F.sum(X.total_eggs()).alias("eggs")))


def daily_sales(t: Tables, as_of, period: int) -> DataFrame:
    return (t.sales.filter(P.trailing_window("sale_date", as_of, period) & P.active_only())
            .groupBy(F.col("sale_date").alias("d"))
            .agg(F.sum("total").cast("double").alias("total")))


def daily_expenses(t: Tables, as_of, period: int) -> DataFrame:
    return (t.expenses.filter(P.trailing_window("expense_date", as_of, period) & P.active_only())
            .groupBy(F.col("expense_date").alias("d"))
            .agg(F.sum("amount").cast("double").alias("total")))


def monthly_production(t: Tables, as_of) -> DataFrame:
    return (t.daily_collections
            .filter(P.trailing_12_months("collection_date", as_of) & P.active_only())
            .groupBy(X.month_bucket("collection_date").alias("d"))
            .agg(F.sum(X.total_eggs()).alias("eggs")))


def monthly_sales(t: Tables, as_of) -> DataFrame:
    return (t.sales.filter(P.trailing_12_months("sale_date", as_of) & P.active_only())
            .groupBy(X.month_bucket("sale_date").alias("d"))
            .agg(F.sum("total").cast("double").alias("total")))


def monthly_expenses(t: Tables, as_of) -> DataFrame:
    return (t.expenses.filter(P.trailing_12_months("expense_date", as_of) & P.active_only())
            .groupBy(X.month_bucket("expense_date").alias("d"))
            .agg(F.sum("amount").cast("double").alias("total")))


# -- series ----------------------------------------------------------------------
def _narrow(df: DataFrame, date_col: str, bucket, eggs, sales, expenses) -> DataFrame:
    return df.select(bucket(F.col(date_col)).alias("d"), eggs.alias("eggs"),
                     sales.alias("sales"), expenses.alias("expenses"))


def report_series(t: Tables, period: int, as_of) -> DataFrame:
    """Zero-filled series: label, date, eggs, sales, expenses, profit.

    Days for 7 and 30, calendar months for 365 (SURVEY §2.14 row 2)."""
    grain = _grain(period)
    if grain == "day":
        cal = calendar_days(t.spark, as_of, period)
        keep = lambda c: P.window_bounded(c, as_of, period)
        bucket = lambda c: c
        label = X.day_label
    else:
        cal = calendar_months(t.spark, as_of)
        keep = lambda c: P.months_bounded(c, as_of)
        bucket = lambda c: F.trunc(c, "MM")
        label = X.month_label
    zero_eggs = F.lit(0).cast("bigint")
    parts = [
        cal.select(F.col("d"), zero_eggs.alias("eggs"), _zero_money().alias("sales"), _zero_money().alias("expenses")),
        _narrow(t.daily_collections.filter(keep("collection_date") & P.active_only()), "collection_date",
                bucket, X.total_eggs().cast("bigint"), _zero_money(), _zero_money()),
        _narrow(t.sales.filter(keep("sale_date") & P.active_only()), "sale_date",
                bucket, zero_eggs, F.col("total"), _zero_money()),
        _narrow(t.expenses.filter(keep("expense_date") & P.active_only()), "expense_date",
                bucket, zero_eggs, _zero_money(), F.col("amount")),
    ]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    agg = u.groupBy("d").agg(F.sum("eggs").alias("eggs"), F.sum("sales").alias("s"),
                             F.sum("expenses").alias("e"))
    return agg.select(
        label("d").alias("label"),
        F.col("d").alias("date"),
        F.col("eggs"),
        F.col("s").cast("double").alias("sales"),
        F.col("e").cast("double").alias("expenses"),
        (F.col("s").cast("double") - F.col("e").cast("double")).alias("profit"),
    ).orderBy("date")  # at most 31 days or 12 months


def report_kpis(t: Tables, period: int, as_of, series: DataFrame | None = None) -> DataFrame:
    """Client KPIs of the report, computed over the series (one row).

    Totals come from the exact decimal sums; the average is per point (per month
    for 365, as the reference does); the best point is the earliest one with the
    most eggs and is absent when nothing was laid; laying rate is avg / birds."""
    s = series if series is not None else report_series(t, period, as_of)
    birds = active_birds(t)
    k = s.agg(
        F.count(F.lit(1)).alias("points"),
        F.sum("eggs").alias("eggs"),
        F.sum(F.col("sales").cast("decimal(22,2)")).cast("double").alias("sales"),
        F.sum(F.col("expenses").cast("decimal(22,2)")).cast("double").alias("expenses"),
        F.max_by(F.struct("date", "label", "eggs"),
                 F.struct(F.col("eggs"), -F.unix_date(F.col("date")))).alias("best"),
    )
    out = k.select(
        F.lit(period).alias("period"),
        F.col("points"),
        F.col("eggs"),
        F.col("sales"),
        F.col("expenses"),
        (F.col("sales") - F.col("expenses")).alias("profit"),
        X.js_round(F.col("eggs") / F.col("points")).cast("bigint").alias("avg_eggs"),
        F.when(F.col("best.eggs") > 0, F.col("best.date")).alias("best_date"),
        F.when(F.col("best.eggs") > 0, F.col("best.label")).alias("best_label"),
        F.when(F.col("best.eggs") > 0, F.col("best.eggs")).alias("best_eggs"),
    )
    # birds is a one-row global aggregate: attach it like a scalar subquery value.
    out = _attach_scalar(out, birds)
    return out.withColumn("laying_rate", X.laying_rate("avg_eggs", "birds"))


def _attach_scalar(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row global aggregate to every row of ``df`` as
    scalar subqueries (no join: each value is computed once and inlined; Spark
    merges subqueries over the same plan into one execution)."""
    for c in one_row.columns:
        df = df.withColumn(c, one_row.select(c).scalar())
    return df


def active_birds(t: Tables) -> DataFrame:
    """Σ bird_count of the active sheds (one row)."""
    return (t.galpones.filter(F.col("active"))
            .agg(F.coalesce(F.sum("bird_count"), F.lit(0)).cast("bigint").alias("birds")))


def production_by_category(t: Tables, period: int, as_of) -> DataFrame:
    """Eggs per size in the trailing window, one row per size with its bar width."""
    one = (t.daily_collections
           .filter(P.trailing_window("collection_date", as_of, period) & P.active_only())
           .agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in schemas.CATEGORIES]))
    long = one.unpivot([], schemas.CATEGORIES, "category", "eggs")
    return with_share_of_max(long.select(
        "category", "eggs",
        X.category_rank("category").alias("category_rank"),
        X.display_rank("category").alias("display_rank"),
        X.label("category", "category").alias("category_label"),
    ), "eggs", "bar_pct")


def with_share_of_max(df: DataFrame, col: str, name: str = "bar_pct") -> DataFrame:
    """Bar width of each row against the largest value: the maximum is a one-row
    global aggregate attached as a scalar subquery (no window that would pull
    every row into one partition)."""
    mx = df.agg(F.max(col).alias("__max"))
    return _attach_scalar(df, mx).withColumn(name, X.share_of_max(F.col(col), F.col("__max"))).drop("__max")


def sales_by_category(t: Tables, period: int, as_of) -> DataFrame:
    """Σ line_total and Σ eggs per size for the active sales of the window."""
    sales = t.sales.filter(P.trailing_window("sale_date", as_of, period) & P.active_only()).select("id")
    items = t.items_between(lambda c: P.trailing_window(c, as_of, period)).select("sale_id", "category", "quantity", "eggs_per_unit", "line_total")
    j = items.join(sales, items.sale_id == sales.id, "inner")
    return j.groupBy("category").agg(
        F.sum("line_total").cast("double").alias("total"),
        F.sum(X.line_eggs("quantity", "eggs_per_unit")).alias("eggs"),
    )


def report_by_size(t: Tables, period: int, as_of) -> DataFrame:
    """The per-size part of the report in one table: eggs laid (trailing window) and
    eggs / money sold per size, sizes without sales kept (full outer join of two
    five-row aggregates)."""
    prod = production_by_category(t, period, as_of).select("category", F.col("eggs").alias("produced"))
    sold = sales_by_category(t, period, as_of).select("category", F.col("eggs").alias("sold"),
                                                      F.col("total").alias("sales_total"))
    j = prod.join(sold, "category", "full")
    return j.select("category", F.coalesce("produced", F.lit(0)).cast("bigint").alias("produced"),
                    F.coalesce("sold", F.lit(0)).cast("bigint").alias("sold"),
                    F.coalesce("sales_total", F.lit(0.0)).alias("sales_total"),
                    X.category_rank("category").alias("category_rank"))


PERIODS = (7, 30, 365)
REPORT = ["period", "part", "pos", "label", "date", "eggs", "sales", "expenses", "profit", "sold", "points", "avg_eggs", "best_eggs",
          "birds", "laying_rate"]


def _first_days(as_of) -> dict[int, F.Column]:
    """The first day of each period's series, and of its trailing window."""
    d0 = X.lit_date(as_of)
    return {p: F.add_months(F.trunc(d0, "MM"), -11) if _grain(p) == "month" else F.date_sub(d0, p - 1) for p in PERIODS}


def daily_totals(t: Tables, as_of) -> DataFrame:
    """Per day from the first day any period needs: eggs by size, money in and out, and eggs
    and money sold by size. Every fact table is read once; the result has a row per day
    with records."""
    lo = F.least(*_first_days(as_of).values(), *[F.date_sub(X.lit_date(as_of), p - 1) for p in PERIODS])
    money = "decimal(22,2)"
    measures = {**{s: "bigint" for s in schemas.CATEGORIES}, "sales": money, "expenses": money,
                **{f"sold_{s}": "bigint" for s in schemas.CATEGORIES}, **{f"earned_{s}": money for s in schemas.CATEGORIES}}

    def part(df, date_col, **given):
        rows = df.filter((F.col(date_col) >= lo) & P.active_only())
        return rows.select(F.col(date_col).alias("d"), *[given.get(m, F.lit(None)).cast(kind).alias(m) for m, kind in measures.items()])

    size = lambda s, x: F.when(F.col("category") == s, x)
    items = t.items_between(lambda c: F.col(c) >= lo).select("sale_id", "category", X.line_eggs("quantity", "eggs_per_unit").alias("n"), F.col("line_total").alias("money"))
    recent = t.sales.filter((F.col("sale_date") >= lo) & P.active_only()).select("id", "sale_date", "total")
    # a sale and its items: the items are added up per sale before the join, the total counts once
    each = items.groupBy("sale_id").agg(*[F.sum(size(s, F.col("n"))).alias(f"sold_{s}") for s in schemas.CATEGORIES],
                                        *[F.sum(size(s, F.col("money"))).alias(f"earned_{s}") for s in schemas.CATEGORIES])
    sold = recent.join(each, recent.id == each.sale_id, "left").withColumn("voided_at", F.lit(None))
    by_size = [f"{kind}_{s}" for kind in ("sold", "earned") for s in schemas.CATEGORIES]
    u = (part(t.daily_collections, "collection_date", **{s: F.col(s) for s in schemas.CATEGORIES})
         .unionByName(part(sold, "sale_date", sales=F.col("total"), **{c: F.col(c) for c in by_size}))
         .unionByName(part(t.expenses, "expense_date", expenses=F.col("amount"))))
    return u.groupBy("d").agg(*[F.sum(m).alias(m) for m in measures])


def report(t: Tables, as_of) -> DataFrame:
    """The report of all periods in one result, one row per point, size and period:

    * ``series`` — the points of the period in order (days, or calendar months for 365),
      zero-filled, with eggs, sales, expenses and profit;
    * ``size`` — per size in enum order: eggs laid (``eggs``), eggs and money sold (``sold``,
      ``sales``) in the trailing window, whose end is open as in the stand-alone totals;
    * ``kpi`` — totals over the points, the average per point, the earliest best point
      (label, date, best_eggs; none if nothing was laid), birds and laying rate.

    The facts are read once, into one row per day; everything else is made of those rows.
    They are counted over the calendar, so their number does not grow with the facts."""
    days = daily_totals(t, as_of)
    d0, first = X.lit_date(as_of), _first_days(as_of)
    periods = t.spark.range(1).select(F.explode(F.array(*[
        F.struct(F.lit(p).alias("period"), F.lit(_grain(p)).alias("grain"), first[p].alias("lo"), F.date_sub(d0, p - 1).alias("from"))
        for p in PERIODS])).alias("p")).select("p.*")
    eggs = sum((F.coalesce(F.col(s), F.lit(0)) for s in schemas.CATEGORIES), F.lit(0)).cast("bigint")
    step = F.when(F.col("grain") == "month", F.sequence(F.col("lo"), F.trunc(F.lit(d0), "MM"), F.expr("INTERVAL 1 MONTH"))).otherwise(
        F.sequence(F.col("lo"), d0, F.expr("INTERVAL 1 DAY")))
    zero = F.lit(0).cast("decimal(22,2)")
    points = periods.select("period", "grain", F.explode(step).alias("d"), F.lit(0).cast("bigint").alias("eggs"),
                            zero.alias("sales"), zero.alias("expenses"))
    # a day counts in every period that reaches back to it: three copies of a row at most
    copies = days.select("*", eggs.alias("eggs"), F.explode(F.array(*[
        F.struct(F.lit(p).alias("period"), F.lit(_grain(p)).alias("grain"), first[p].alias("lo"), F.date_sub(d0, p - 1).alias("from"))
        for p in PERIODS])).alias("p")).select("*", "p.*").drop("p")
    last = F.when(F.col("grain") == "month", F.last_day(F.lit(d0))).otherwise(d0)  # the last month counts whole
    inside = copies.filter((F.col("d") >= F.col("lo")) & (F.col("d") <= last)).select(
        "period", "grain", F.when(F.col("grain") == "month", F.trunc("d", "MM")).otherwise(F.col("d")).alias("d"), "eggs",
        F.coalesce("sales", zero).alias("sales"), F.coalesce("expenses", zero).alias("expenses"))
    series = points.unionByName(inside).groupBy("period", "grain", "d").agg(
        F.sum("eggs").alias("eggs"), F.sum("sales").alias("sales"), F.sum("expenses").alias("expenses"))
    label = F.when(F.col("grain") == "month", X.month_label("d")).otherwise(X.day_label("d"))
    series = series.withColumn("label", label)
    null = lambda kind: F.lit(None).cast(kind)
    place = F.row_number().over(Window.partitionBy("period").orderBy("d")).cast("int")
    blank = {"label": null("string"), "date": null("date"), "eggs": null("bigint"), "sales": null("double"), "expenses": null("double"),
             "profit": null("double"), "sold": null("bigint"), "points": null("bigint"), "avg_eggs": null("bigint"),
             "best_eggs": null("bigint"), "birds": null("bigint"), "laying_rate": null("bigint")}

    def rows(df, part, pos, **given):
        return df.select("period", F.lit(part).alias("part"), pos.alias("pos"), *[given.get(c, blank[c]).alias(c) for c in REPORT[3:]])

    money = lambda c: F.col(c).cast("double")
    line = rows(series, "series", place, label=F.col("label"), date=F.col("d"), eggs=F.col("eggs"), sales=money("sales"),
                expenses=money("expenses"), profit=money("sales") - money("expenses"))
    window = copies.filter(F.col("d") >= F.col("from")).groupBy("period").agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for s in schemas.CATEGORIES for c in (s, f"sold_{s}", f"earned_{s}")])
    sizes = periods.select("period").join(window, "period", "left").select("period", F.explode(F.array(*[
        F.struct(F.lit(k + 1).alias("pos"), F.lit(s).alias("label"), F.coalesce(F.col(s), F.lit(0)).cast("bigint").alias("eggs"),
                 F.coalesce(F.col(f"sold_{s}"), F.lit(0)).cast("bigint").alias("sold"),
                 F.coalesce(F.col(f"earned_{s}"), F.lit(0)).cast("double").alias("sales"))
        for k, s in enumerate(schemas.CATEGORIES)])).alias("c")).select("period", "c.*")
    size = rows(sizes, "size", F.col("pos"), label=F.col("label"), eggs=F.col("eggs"), sold=F.col("sold"), sales=F.col("sales"))
    k = series.groupBy("period").agg(
        F.count(F.lit(1)).alias("points"), F.sum("eggs").alias("eggs"), F.sum("sales").alias("sales"), F.sum("expenses").alias("expenses"),
        F.max_by(F.struct("d", "label", "eggs"), F.struct(F.col("eggs"), -F.unix_date("d"))).alias("best"))
    k = _attach_scalar(k, active_birds(t)).withColumn("avg_eggs", X.js_round(F.col("eggs") / F.col("points")).cast("bigint"))
    best = lambda c: F.when(F.col("best.eggs") > 0, F.col(f"best.{c}"))
    kpi = rows(k, "kpi", F.lit(1), label=best("label"), date=best("d"), best_eggs=best("eggs"), eggs=F.col("eggs"), sales=money("sales"),
               expenses=money("expenses"), profit=money("sales") - money("expenses"), points=F.col("points"), avg_eggs=F.col("avg_eggs"),
               birds=F.col("birds"), laying_rate=X.laying_rate("avg_eggs", "birds"))
    return line.unionByName(size).unionByName(kpi).orderBy("period", "part", "pos")


def total_vs_lines(t: Tables) -> DataFrame:
    """Audit: sales whose total is not the sum of their lines (a sale without lines sums to
    0). The items are added up per sale before they meet the sales."""
    lines = t.sale_items.groupBy("sale_id").agg(F.sum("line_total").alias("lines"), F.count(F.lit(1)).alias("items"))
    return (t.sales.join(lines, F.col("id") == F.col("sale_id"), "left")
            .select("id", "sale_date", "total", F.coalesce("lines", F.lit(0)).cast("decimal(22,2)").alias("lines"),
                    F.coalesce("items", F.lit(0)).cast("bigint").alias("items"))
            .withColumn("difference", (F.col("total") - F.col("lines")).cast("decimal(22,2)")).filter("difference <> 0"))


# -- day summary -------------------------------------------------------------------
def dashboard_today(t: Tables, as_of) -> DataFrame:
    """The day summary in one row: production by size, sales and expenses of today
    and yesterday, profit, trend, active birds and laying rate.

    Each fact table is read once with conditional sums (today / yesterday in the
    same pass); the three one-row aggregates and the birds total are combined by
    constant-key joins of one-row frames."""
    d0 = X.lit_date(as_of)
    d1 = F.date_sub(d0, 1)
    col = (t.daily_collections.filter((F.col("collection_date") == d0) & P.active_only())
           .agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c)
                  for c in schemas.CATEGORIES + ["rotos"]]))
    sal = (t.sales.filter(F.col("sale_date").isin(d0, d1) & P.active_only())
           .agg(F.coalesce(F.sum(F.when(F.col("sale_date") == d0, F.col("total"))), F.lit(0)).cast("double").alias("sales_total"),
                F.count(F.when(F.col("sale_date") == d0, F.lit(1))).cast("bigint").alias("sales_count"),
                F.coalesce(F.sum(F.when(F.col("sale_date") == d1, F.col("total"))), F.lit(0)).cast("double").alias("sales_yesterday")))
    exp = (t.expenses.filter(F.col("expense_date").isin(d0, d1) & P.active_only())
           .agg(F.coalesce(F.sum(F.when(F.col("expense_date") == d0, F.col("amount"))), F.lit(0)).cast("double").alias("expenses_total"),
                F.count(F.when(F.col("expense_date") == d0, F.lit(1))).cast("bigint").alias("expenses_count"),
                F.coalesce(F.sum(F.when(F.col("expense_date") == d1, F.col("amount"))), F.lit(0)).cast("double").alias("expenses_yesterday")))
    out = _attach_scalar(_attach_scalar(_attach_scalar(col, sal), exp), active_birds(t))
    out = out.withColumn("production", X.total_eggs().cast("bigint"))
    out = out.withColumn("profit", F.col("sales_total") - F.col("expenses_total"))
    out = out.withColumn("profit_yesterday", F.col("sales_yesterday") - F.col("expenses_yesterday"))
    trend = X.profit_trend("profit", "profit_yesterday")
    return out.select(
        "*",
        X.laying_rate("production", "birds").alias("laying_rate"),
        trend["pct"].alias("trend_pct"), trend["label"].alias("trend_label"),
        trend["tone"].alias("trend_tone"), trend["dir"].alias("trend_dir"),
    )


def dashboard_with_stock(t: Tables, as_of, inventory: DataFrame) -> DataFrame:
    """The day summary with the stock of all farms per size (``inventory``: category,
    quantity; from a snapshot or a fold of the log)."""
    stock = inventory.agg(*[F.coalesce(F.sum(F.when(F.col("category") == c, F.col("quantity"))), F.lit(0)).cast("bigint").alias(f"stock_{c}")
                            for c in schemas.CATEGORIES])
    return _attach_scalar(dashboard_today(t, as_of), stock)
