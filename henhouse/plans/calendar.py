"""Calendars: bounded date spines used to zero-fill series.

A calendar has at most ``period`` rows (<= 366 days or 12 months), so it is safe
to broadcast; it is generated with ``explode(sequence(...))`` on one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from henhouse.functions.exprs import _c, lit_date


def day_sequence(start: Column, end: Column) -> Column:
    return F.sequence(start, end, F.expr("INTERVAL 1 DAY"))


def month_sequence(start: Column, end: Column) -> Column:
    return F.sequence(start, end, F.expr("INTERVAL 1 MONTH"))


def calendar_days(spark: SparkSession, as_of, period: int, name: str = "d") -> DataFrame:
    """Dates as_of-(period-1) ... as_of."""
    end = lit_date(as_of)
    return spark.range(1).select(
        F.explode(day_sequence(F.date_sub(end, int(period) - 1), end)).alias(name)
    )


def calendar_months(spark: SparkSession, as_of, name: str = "d") -> DataFrame:
    """The twelve first-of-month dates ending with the month of as_of."""
    end = F.trunc(lit_date(as_of), "MM")
    return spark.range(1).select(F.explode(month_sequence(F.add_months(end, -11), end)).alias(name))


def days_between(df: DataFrame, start, end, name: str = "d") -> DataFrame:
    """One row per day between two date columns of each input row (a per-row
    generator, not a join: used to give every shed its own zero-filled days)."""
    return df.select("*", F.explode(day_sequence(_c(start), _c(end))).alias(name))


def months_between(df: DataFrame, start, end, name: str = "d") -> DataFrame:
    return df.select("*", F.explode(month_sequence(_c(start), _c(end))).alias(name))
