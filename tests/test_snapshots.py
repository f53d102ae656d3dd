"""Stock from snapshots: equal to the full fold, whatever was recorded when."""

import datetime as dt
import os
import tempfile

from pyspark.sql import functions as F

from henhouse.plans import snapshots as SN
from henhouse.plans import stock as ST


def _stock(df):
    return sorted((r.farm_id, *[r[s] for s in SN.SIZES]) for r in df.collect())


def _full(log):
    folded = ST.run(log, SN.ALL_MODES)
    last = folded.groupBy("farm_id").agg(F.max_by(F.struct(*[F.col(f"after_{s}").alias(s) for s in SN.SIZES]), F.struct(*ST.ORDER)).alias("st"))
    return _stock(last.select("farm_id", "st.*"))


def _log(tables):
    """The changes of some farms, written once."""
    path = os.path.join(tempfile.mkdtemp(prefix="henhouse-book-"), "log")
    ST.stock_log(tables).filter("farm_id % 2 = 0").write.parquet(path)
    return tables.spark.read.parquet(path)


def test_snapshot_and_tail_equal_the_full_fold(spark, tables_small):
    log = _log(tables_small)
    book = SN.StockBook(spark, os.path.join(tempfile.mkdtemp(prefix="henhouse-book-"), "b"), log.schema)
    # a day between a sale and its edit
    edit = log.filter("ref IS NOT NULL AND op_date > '1995-01-01'").orderBy("op_date").first().op_date
    cut, later = edit - dt.timedelta(days=2), dt.date(1997, 6, 30)
    book.record(log.filter(F.col("op_date") <= F.lit(cut)), "facts", 1)
    book.snapshot(cut)
    book.record(log.filter(F.col("op_date") > F.lit(cut)), "facts", 2)
    book.record(log.filter(F.col("op_date") > F.lit(cut)), "facts", 2)  # the job ran twice
    want = _full(log)
    assert _stock(book.current()) == want
    # sales before the snapshot are voided and edited after it
    tail = book._tail(book.usable(), None)
    known = book._outcomes(book.usable())
    assert tail.filter("ref IS NOT NULL").join(known.select(F.col("op_id").alias("ref")), "ref", "left_semi").count() > 0
    # a second snapshot is made of the first; then only later months are read
    book.snapshot(later)
    assert _stock(book.current()) == want
    plan = book._tail(book.usable(), None)._jdf.queryExecution().executedPlan().toString()
    assert "year_month" in plan.split("PartitionFilters")[1][:200] and ">= 1997-06" in plan and book.usable()["day"] == "1997-06-30"
    assert book.snapshot(cut)["day"] == "1997-06-30"  # nothing to do
    times = {r.farm_id: r.updated_at for r in book.current().collect()}
    assert max(times.values()) <= log.agg(F.max("recorded_at")).first()[0]


def test_a_late_change_invalidates_what_covers_it(spark, tables_small):
    log = _log(tables_small)
    book = SN.StockBook(spark, os.path.join(tempfile.mkdtemp(prefix="henhouse-book-"), "b"), log.schema)
    late = (F.col("op_date") == F.lit("1996-05-20").cast("date")) | F.col("op_id").endswith("7") & (F.col("op_date") > F.lit("1996-05-20").cast("date"))
    book.record(log.filter(~late), "facts", 1)
    book.snapshot(dt.date(1994, 12, 31))
    book.snapshot(dt.date(1997, 1, 31))
    assert _stock(book.current()) == _full(log.filter(~late))
    book.record(log.filter(late), "late", 1)
    assert book.usable()["day"] == "1994-12-31"
    assert _stock(book.current()) == _full(log)


def test_no_snapshot_and_empty_log(spark, tables_small):
    log = ST.stock_log(tables_small)
    book = SN.StockBook(spark, os.path.join(tempfile.mkdtemp(prefix="henhouse-book-"), "b"), log.schema)
    assert book.usable() is None and book.current().count() == 0 and book.inventory().count() == 0
