"""Adapter views: the driver's TPC-H-like tables seen as the farm's domain tables.

The same SQL text is used twice: by :class:`henhouse.sources.tables.Tables` through
``spark.sql(text, **frames)`` (placeholders become the parquet DataFrames) and by
the DuckDB oracle as a ``WITH`` prelude (placeholders become table names). Only the
mapping is shared; every operator on top is written independently per engine.
"""

from __future__ import annotations

# p_size -> egg size, as described in FIXTURES.md.
_CAT = (
    "CASE p.p_size % 5 WHEN 0 THEN 'pequeno' WHEN 1 THEN 'mediano' WHEN 2 THEN 'grande' "
    "WHEN 3 THEN 'extra_grande' ELSE 'jumbo' END"
)

# Voids are recorded some days after the record, so that other records lie between.
_VOIDED = "CASE WHEN o.o_orderstatus = 'P' AND o.o_orderkey % 4 = 0 THEN o.o_orderdate + INTERVAL 9 DAY END"

# Farms and sheds are the suppliers, whose number grows with the data.
_FARM = "o.o_custkey % (SELECT count(*) FROM {supplier})"


def _size_sum(cat: str) -> str:
    return f"CAST(sum(CASE WHEN cat = '{cat}' THEN q * 30 ELSE 0 END) AS INT) AS {cat}"


# name -> (SQL text, raw or view inputs it reads). Listed in dependency order.
VIEWS: dict[str, tuple[str, tuple[str, ...]]] = {
    "galpones": (
        """SELECT s_suppkey AS id, s_name AS name,
                  CAST(floor(abs(s_acctbal)) AS INT) AS bird_count,
                  s_suppkey % 7 <> 0 AS active
           FROM {supplier}""",
        ("supplier",),
    ),
    "users": (
        """SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name,
                  CASE WHEN n_regionkey = 0 THEN 'admin' ELSE 'trabajador' END AS role,
                  n_nationkey % 6 <> 5 AS active
           FROM {nation}""",
        ("nation",),
    ),
    "sales": (
        f"""SELECT o.o_orderkey AS id, CAST(o.o_orderdate AS DATE) AS sale_date,
                  CASE o.o_custkey % 10 WHEN 0 THEN NULL WHEN 1 THEN '  '
                       WHEN 2 THEN concat('  ', c.c_name, ' ') ELSE c.c_name END AS customer,
                  CAST(o.o_totalprice AS DECIMAL(12,2)) AS total,
                  o.o_custkey % 27 AS created_by,
                  {_FARM} AS farm_id,
                  o.o_orderdate AS created_at,
                  {_VOIDED} AS voided_at
           FROM {{orders}} o JOIN {{customer}} c ON c.c_custkey = o.o_custkey
           WHERE o.o_orderpriority <> '5-LOW'""",
        ("orders", "customer", "supplier"),
    ),
    "sale_items": (
        f"""SELECT l.l_orderkey AS sale_id,
                  CASE l.l_linenumber % 3 WHEN 0 THEN 'cajon' WHEN 1 THEN 'oferta_grande'
                       ELSE 'carton' END AS product_type,
                  {_CAT} AS category,
                  CAST(l.l_quantity AS INT) AS quantity,
                  CASE l.l_linenumber % 3 WHEN 0 THEN 360 WHEN 1 THEN 90 ELSE 30 END AS eggs_per_unit,
                  CAST(p.p_retailprice AS DECIMAL(12,2)) AS unit_price,
                  CAST(CAST(l.l_quantity AS INT) * CAST(p.p_retailprice AS DECIMAL(12,2))
                       AS DECIMAL(12,2)) AS line_total
           FROM {{lineitem}} l
           JOIN {{part}} p ON p.p_partkey = l.l_partkey
           JOIN {{sales}} s ON s.id = l.l_orderkey""",
        ("lineitem", "part", "sales"),
    ),
    "daily_collections": (
        f"""SELECT concat(CAST(d AS VARCHAR(10)), '-', CAST(s AS VARCHAR(10))) AS id,
                  d AS collection_date,
                  {_size_sum('pequeno')}, {_size_sum('mediano')}, {_size_sum('grande')},
                  {_size_sum('extra_grande')}, {_size_sum('jumbo')},
                  CAST(count(CASE WHEN rf = 'R' THEN 1 END) AS INT) AS rotos,
                  CASE WHEN s % 11 = 0 THEN NULL ELSE s END AS galpon_id,
                  s % 27 AS created_by,
                  s AS farm_id,
                  max(ship) AS created_at,
                  CASE WHEN (day(d) + s) % 9 = 0 THEN max(ship) + INTERVAL 9 DAY END AS voided_at
           FROM (SELECT CAST(l.l_shipdate AS DATE) AS d, l.l_suppkey AS s, {_CAT} AS cat,
                        CAST(l.l_quantity AS INT) AS q, l.l_returnflag AS rf,
                        l.l_shipdate AS ship
                 FROM {{lineitem}} l JOIN {{part}} p ON p.p_partkey = l.l_partkey) x
           GROUP BY d, s""",
        ("lineitem", "part"),
    ),
    "expenses": (
        f"""SELECT o.o_orderkey AS id, CAST(o.o_orderdate AS DATE) AS expense_date,
                  CASE c.c_mktsegment WHEN 'MACHINERY' THEN 'Materia prima'
                       WHEN 'AUTOMOBILE' THEN 'Transporte' WHEN 'BUILDING' THEN 'Otros'
                       WHEN 'HOUSEHOLD' THEN 'Medicamentos' ELSE 'Alimento' END AS category,
                  CAST(abs(c.c_acctbal) AS DECIMAL(12,2)) AS amount,
                  o.o_custkey % 13 AS galpon_id,
                  o.o_custkey % 27 AS created_by,
                  {_FARM} AS farm_id,
                  o.o_orderdate AS created_at,
                  {_VOIDED} AS voided_at
           FROM {{orders}} o JOIN {{customer}} c ON c.c_custkey = o.o_custkey
           WHERE o.o_orderpriority = '5-LOW'""",
        ("orders", "customer", "supplier"),
    ),
    "bird_events": (
        """SELECT event_id AS id, user_id % (SELECT count(*) FROM {supplier}) AS galpon_id,
                  CAST(ts - INTERVAL 6 HOUR AS DATE) AS event_date,
                  CASE event_type WHEN 'signup' THEN 'ingreso' WHEN 'error' THEN 'muerte'
                       ELSE 'ajuste' END AS type,
                  CAST(CASE WHEN event_type = 'signup' THEN 1 WHEN event_type = 'error' THEN -1
                            WHEN event_id % 2 = 0 THEN 1 ELSE -1 END * (1 + floor(value)) AS INT) AS delta,
                  ts AS created_at,
                  CASE WHEN event_id % 17 = 0 THEN ts + INTERVAL 2 DAY END AS voided_at
           FROM {events}""",
        ("events", "supplier"),
    ),
}

RAW_TABLES = ("supplier", "nation", "orders", "customer", "lineitem", "part", "events")
