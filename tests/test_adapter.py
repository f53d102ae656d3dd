"""Adapter views reproduce the check values of FIXTURES.md at sf0.01."""

from pyspark.sql import functions as F


def test_galpones(tables_mid):
    r = tables_mid.galpones.agg(F.count("*"), F.sum("bird_count"), F.sum(F.col("active").cast("int"))).first()
    assert tuple(r) == (100, 463836, 85)


def test_sales(tables_mid):
    s = tables_mid.sales
    r = s.agg(F.count("*"), F.sum("total"), F.count("voided_at")).first()
    assert r[0] == 12004 and str(r[1]) == "3019447277.68" and r[2] == 1006
    named = s.filter(F.nullif(F.trim("customer"), F.lit("")).isNotNull())
    assert named.count() == 9642
    assert s.select(F.nullif(F.trim("customer"), F.lit(""))).distinct().count() == 1200  # 1,199 + the NULL group


def test_items_and_collections(tables_mid):
    i = tables_mid.sale_items.agg(F.count("*"), F.sum("line_total"),
                                  F.sum(F.col("quantity") * F.col("eggs_per_unit"))).first()
    assert i[0] == 47983 and str(i[1]) == "1158665396.80" and i[2] == 184224840
    dc = tables_mid.daily_collections
    eggs = sum(F.col(c) for c in ["pequeno", "mediano", "grande", "extra_grande", "jumbo"])
    r = dc.agg(F.count("*"), F.countDistinct("id"), F.sum(eggs), F.sum("rotos"), F.count("voided_at"),
               F.count("galpon_id"), F.max("collection_date")).first()
    assert tuple(r[:6]) == (53307, 53307, 45724050, 20046, 5852, 47999)
    assert str(r[6]) == "2001-11-04"


def test_expenses_and_birds(tables_mid):
    e = tables_mid.expenses.agg(F.count("*"), F.sum("amount"), F.count("voided_at")).first()
    assert e[0] == 2996 and str(e[1]) == "13536183.72" and e[2] == 257
    b = tables_mid.bird_events.agg(F.count("*"), F.sum("delta"), F.count("voided_at"),
                                   F.min("event_date"), F.max("event_date"), F.sum((F.col("delta") == 0).cast("int"))).first()
    assert (b[0], b[1], b[2]) == (10000, 2747, 589)
    assert (str(b[3]), str(b[4]), b[5]) == ("2023-12-31", "2024-01-30", 0)


def test_seven_day_series(tables_mid):
    from henhouse.plans.reports import report_series

    rows = report_series(tables_mid, 7, "2001-07-15").collect()
    eggs = [r.eggs for r in rows]
    assert len(rows) == 7 and min(eggs) == 9540 and max(eggs) == 20340 and sum(eggs) == 106080
