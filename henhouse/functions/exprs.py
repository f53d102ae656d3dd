"""Scalar column functions. All return JVM-side Columns."""

from __future__ import annotations

import datetime as _dt
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from henhouse import schemas


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lit_date(d) -> Column:
    if isinstance(d, str):
        d = _dt.date.fromisoformat(d)
    return F.lit(d)


def total_eggs(prefix: str = "") -> Column:
    """Sum of the five sizes; broken eggs are counted apart and never included."""
    cols = [F.col(f"{prefix}{c}") for c in schemas.CATEGORIES]
    out = cols[0]
    for c in cols[1:]:
        out = out + c
    return out


def map_lit(mapping: dict) -> Column:
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in mapping.items()))


def eggs_per_unit(product_type) -> Column:
    """Eggs in one unit of a product (crate 360, large offer 90, carton 30)."""
    pt = _c(product_type)
    out = None
    for k, v in schemas.EGGS_PER_UNIT.items():
        out = (F.when(pt == k, F.lit(v)) if out is None else out.when(pt == k, F.lit(v)))
    return out


def line_total(quantity, unit_price) -> Column:
    return (_c(quantity) * _c(unit_price)).cast(schemas.MONEY)


def line_eggs(quantity, eggs_unit) -> Column:
    return _c(quantity).cast("bigint") * _c(eggs_unit)


def normalise_customer(customer) -> Column:
    """NULLIF(trim(customer), ''): spaces only are stripped, NULL and blank collapse."""
    return F.nullif(F.trim(_c(customer)), F.lit(""))


def js_round(x) -> Column:
    """JavaScript Math.round: halves go up (towards +inf), so -2.5 -> -2."""
    return F.floor(_c(x) + F.lit(0.5))


def profit(sales, expenses) -> Column:
    return F.coalesce(_c(sales), F.lit(0.0)) - F.coalesce(_c(expenses), F.lit(0.0))


def profit_trend(today, yesterday) -> Column:
    """Trend of today's profit against yesterday's as struct(pct, label, tone, dir).

    pct is the rounded relative change; when yesterday is 0 only the sign of today
    decides (no percentage)."""
    p, y = _c(today), _c(yesterday)
    pct = js_round(F.try_divide(p - y, F.abs(y)) * F.lit(100.0)).cast("bigint")
    pct = F.when(y != 0, pct)
    label = (
        F.when((y != 0) & (pct > 0), F.concat(F.lit("+"), pct.cast("string"), F.lit("% vs ayer")))
        .when((y != 0) & (pct < 0), F.concat(pct.cast("string"), F.lit("% vs ayer")))
        .when(y != 0, F.lit("Igual que ayer"))
        .when(p > 0, F.lit("Positiva"))
        .when(p < 0, F.lit("Negativa"))
        .otherwise(F.lit("Sin movimiento"))
    )
    up = F.when(y != 0, pct > 0).otherwise(p > 0)
    down = F.when(y != 0, pct < 0).otherwise(p < 0)
    tone = F.when(up, F.lit("good")).when(down, F.lit("bad")).otherwise(F.lit("neutral"))
    direction = F.when(up, F.lit("up")).when(down, F.lit("down"))
    return F.struct(pct.alias("pct"), label.alias("label"), tone.alias("tone"), direction.alias("dir"))


def laying_rate(eggs, birds) -> Column:
    """Laying rate in percent, rounded like the client; NULL without birds."""
    b = _c(birds)
    return F.when(b > 0, js_round(F.try_divide(_c(eggs), b) * F.lit(100.0)).cast("bigint"))


def break_rate(broken, eggs) -> Column:
    """Broken share of all eggs in percent with one decimal; 0 when nothing was laid."""
    r, e = _c(broken), _c(eggs)
    return F.when(e + r > 0, F.round(F.try_divide(r, e + r) * F.lit(100.0), 1)).otherwise(F.lit(0.0))


def crates_equiv(eggs) -> Column:
    """Eggs expressed in crates of 360, at most two decimals."""
    return F.round(_c(eggs) / F.lit(float(schemas.CRATE_EGGS)), 2)


def share_of_max(value, max_value) -> Column:
    """Bar width: round(v / max(1, max v) * 100)."""
    return js_round(_c(value) / F.greatest(F.lit(1), _c(max_value)) * F.lit(100.0)).cast("bigint")


def label(kind: str, value) -> Column:
    maps = {
        "category": schemas.CATEGORY_LABELS,
        "product": schemas.PRODUCT_LABELS,
        "bird_event": schemas.BIRD_EVENT_LABELS,
        "record": schemas.RECORD_TYPE_LABELS,
        "role": schemas.ROLE_LABELS,
    }
    return F.element_at(map_lit(maps[kind]), _c(value))


def day_label(d) -> Column:
    return F.date_format(_c(d), "dd/MM")


def month_label(d) -> Column:
    return F.date_format(_c(d), "MMM")


def month_bucket(d) -> Column:
    return F.trunc(_c(d), "MM")


def local_business_date(ts, tz: str = schemas.FARM_TZ) -> Column:
    """Calendar date at the farm for a UTC wall-clock timestamp (session zone free)."""
    return F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(tz), _c(ts).cast("timestamp_ntz")))


def category_rank(category) -> Column:
    """Enum declaration order: the sort order of ORDER BY category."""
    return F.array_position(F.array(*[F.lit(c) for c in schemas.CATEGORIES]), _c(category)).cast("int")


def display_rank(category) -> Column:
    return F.array_position(F.array(*[F.lit(c) for c in schemas.DISPLAY_ORDER]), _c(category)).cast("int")


def bird_delta(event_type, quantity) -> Column:
    """Signed change of birds: +quantity for arrivals, -quantity for deaths."""
    t, q = _c(event_type), _c(quantity)
    return F.when(t == "ingreso", q).when(t == "muerte", -q)


def money_text(x) -> Column:
    """Whole quetzales with thousands separators, as in the notice bodies."""
    return F.concat(F.lit("Q"), F.format_number(F.round(_c(x).cast("decimal(22,2)"), 0), 0))
