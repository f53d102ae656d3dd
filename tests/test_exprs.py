"""Hand cases for the scalar functions."""

import pytest
from pyspark.sql import functions as F

from henhouse.functions import exprs as X
from henhouse.functions import filters as P


def test_js_round_halves_go_up(spark):
    r = spark.createDataFrame([(-2.5,), (2.5,), (-0.5,), (1.49,)], "x double") \
        .select(X.js_round("x").alias("r")).collect()
    assert [x.r for x in r] == [-2, 3, 0, 1]


@pytest.mark.parametrize("p,y,pct,label,tone,direction", [
    (10.0, 0.0, None, "Positiva", "good", "up"),
    (-1.0, 0.0, None, "Negativa", "bad", "down"),
    (0.0, 0.0, None, "Sin movimiento", "neutral", None),
    (5.0, -10.0, 150, "+150% vs ayer", "good", "up"),
    (5.0, 5.0, 0, "Igual que ayer", "neutral", None),
    (5.0, 10.0, -50, "-50% vs ayer", "bad", "down"),
])
def test_profit_trend(spark, p, y, pct, label, tone, direction):
    r = spark.createDataFrame([(p, y)], "p double, y double").select(X.profit_trend("p", "y").alias("t")).first().t
    assert (r.pct, r.label, r.tone, r.dir) == (pct, label, tone, direction)


def test_rates(spark):
    df = spark.createDataFrame([(100, 0, 0), (150, 200, 3), (0, 50, 0)], "eggs long, birds long, broken long")
    r = df.select(X.laying_rate("eggs", "birds").alias("l"), X.break_rate("broken", "eggs").alias("b")).collect()
    assert [(x.l, x.b) for x in r] == [(None, 0.0), (75, 2.0), (0, 0.0)]


def test_customer_normalisation(spark):
    df = spark.createDataFrame([(None,), ("",), ("   ",), (" Ana ",), ("ana",), ("\tAna",)], "c string")
    r = [x.k for x in df.select(X.normalise_customer("c").alias("k")).collect()]
    # spaces only are trimmed; case is kept; a tab is not a space
    assert r == [None, None, None, "Ana", "ana", "\tAna"]
    blank = df.filter(P.by_customer("c", "  ")).count()
    assert blank == 3
    assert df.filter(P.by_customer("c", " Ana")).count() == 1


def test_eggs_per_unit_and_labels(spark):
    df = spark.createDataFrame([("cajon",), ("oferta_grande",), ("carton",)], "p string")
    r = df.select(X.eggs_per_unit("p").alias("e"), X.label("product", "p").alias("l")).collect()
    assert [(x.e, x.l) for x in r] == [(360, "Cajón"), (90, "Oferta"), (30, "Cartón")]


def test_local_business_date(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ'2026-06-05 03:00:00' AS ts")
    assert str(df.select(X.local_business_date("ts").alias("d")).first().d) == "2026-06-04"


def test_crates_and_share(spark):
    df = spark.createDataFrame([(360,), (540,), (0,)], "e long")
    r = df.select(X.crates_equiv("e").alias("c"), X.share_of_max("e", F.lit(540)).alias("s")).collect()
    assert [(x.c, x.s) for x in r] == [(1.0, 67), (1.5, 100), (0.0, 0)]
