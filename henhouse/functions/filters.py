"""Predicates. Plain Columns, so Catalyst pushes them to the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from henhouse.functions.exprs import _c, lit_date, normalise_customer


def active_only(voided_col: str = "voided_at") -> Column:
    """A record counts in totals only while it is not voided."""
    return F.col(voided_col).isNull()


def on_date(date_col: str, as_of) -> Column:
    return F.col(date_col) == lit_date(as_of)


def on_previous_day(date_col: str, as_of) -> Column:
    return F.col(date_col) == F.date_sub(lit_date(as_of), 1)


def trailing_window(date_col: str, as_of, period: int) -> Column:
    """date > as_of - period: lower bound exclusive and no upper bound (future
    dated rows count, as in the reference totals)."""
    return F.col(date_col) > F.date_sub(lit_date(as_of), int(period))


def window_bounded(date_col: str, as_of, period: int) -> Column:
    """The part of the trailing window a calendar series can show: as_of-period < d <= as_of."""
    return trailing_window(date_col, as_of, period) & (F.col(date_col) <= lit_date(as_of))


def month_start(as_of) -> Column:
    return F.trunc(lit_date(as_of), "MM")


def trailing_12_months(date_col: str, as_of) -> Column:
    """date >= first day of the month eleven months before the as_of month."""
    return F.col(date_col) >= F.add_months(month_start(as_of), -11)


def months_bounded(date_col: str, as_of) -> Column:
    return trailing_12_months(date_col, as_of) & (F.col(date_col) < F.add_months(month_start(as_of), 1))


def by_customer(customer_col: str, customer: str | None) -> Column:
    """Null-aware customer match: a blank or missing name selects the no-customer
    group, any other name matches the trimmed stored name exactly."""
    wanted = None if customer is None else customer.strip(" ")
    if not wanted:
        return normalise_customer(customer_col).isNull()
    return normalise_customer(customer_col) == F.lit(wanted)


def active_sheds(galpones: DataFrame) -> DataFrame:
    return galpones.filter(F.col("active"))


def active_admins(users: DataFrame) -> DataFrame:
    return users.filter((F.col("role") == "admin") & F.col("active"))


def by_id(col: str, value) -> Column:
    """The records of one shed, author or customer: a plain predicate, pushed to the scan."""
    return _c(col) == F.lit(value)


def in_keys(df: DataFrame, col: str, keys: DataFrame, key_col: str = "id") -> DataFrame:
    """Rows whose key is among ``keys``: a left semi join, so one job serves every key."""
    return df.join(keys.select(_c(key_col).alias("__k")), F.col(col) == F.col("__k"), "left_semi")
