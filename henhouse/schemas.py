"""Domain vocabulary, fixed values and explicit schemas.

Everything here is data, not logic: the egg sizes, product sizes, labels and the
StructTypes of the domain tables and the offline operation log.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference application's for right results.
# ---------------------------------------------------------------------------

# Egg sizes in enum declaration order (this is also the SQL ORDER BY order).
CATEGORIES = ["pequeno", "mediano", "grande", "extra_grande", "jumbo"]

# Order in which the screens list the sizes.
DISPLAY_ORDER = ["grande", "mediano", "pequeno", "extra_grande", "jumbo"]

# Display names of the sizes.
CATEGORY_LABELS = {
    "pequeno": "Pequeno",
    "mediano": "Mediano",
    "grande": "Grande",
    "extra_grande": "Extra grande",
    "jumbo": "Jumbo",
}

# Sale products and the eggs in one unit of each.
EGGS_PER_UNIT = {"cajon": 360, "oferta_grande": 90, "carton": 30}
PRODUCT_LABELS = {"cajon": "Cajón", "oferta_grande": "Oferta", "carton": "Cartón"}

# One crate (cajon) in eggs; also the low-stock threshold.
CRATE_EGGS = 360
LOW_STOCK_THRESHOLD = 360

BIRD_EVENT_LABELS = {"ingreso": "Entraron", "muerte": "Murieron", "ajuste": "Ajuste"}
RECORD_TYPE_LABELS = {"collection": "Recoleccion", "sale": "Venta", "expense": "Gasto"}
ROLE_LABELS = {"admin": "Administrador", "trabajador": "Trabajador"}

# The farm's business calendar zone (UTC-6, no daylight saving since 2006).
FARM_TZ = "America/Guatemala"

# Report periods in days; 365 switches the series to months.
PERIODS = (7, 30, 365)

# Header of the exported report CSV.
CSV_HEADER = ["Fecha", "Huevos", "Ventas", "Gastos", "Ganancia"]

# Field limits of the input checks.
NOTES_MAX = 500
CUSTOMER_MAX = 160
SUPPLIER_MAX = 160
EXPENSE_CATEGORY_MAX = 80
REASON_MAX = 200
SHED_NAME_MAX = 80
DATE_PATTERN = r"^\d{4}-\d{2}-\d{2}$"

# ---------------------------------------------------------------------------
# Schemas
# ---------------------------------------------------------------------------

MONEY = T.DecimalType(12, 2)

GALPONES = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("bird_count", T.IntegerType()),
    T.StructField("active", T.BooleanType()),
])

USERS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("role", T.StringType()),
    T.StructField("active", T.BooleanType()),
])

DAILY_COLLECTIONS = T.StructType(
    [T.StructField("id", T.StringType()), T.StructField("collection_date", T.DateType())]
    + [T.StructField(c, T.IntegerType()) for c in CATEGORIES + ["rotos"]]
    + [
        T.StructField("galpon_id", T.LongType()),
        T.StructField("created_by", T.LongType()),
        T.StructField("farm_id", T.LongType()),
        T.StructField("created_at", T.TimestampNTZType()),
        T.StructField("voided_at", T.TimestampNTZType()),
    ]
)

SALES = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("sale_date", T.DateType()),
    T.StructField("customer", T.StringType()),
    T.StructField("total", MONEY),
    T.StructField("created_by", T.LongType()),
    T.StructField("farm_id", T.LongType()),
    T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("voided_at", T.TimestampNTZType()),
])

SALE_ITEMS = T.StructType([
    T.StructField("sale_id", T.LongType()),
    T.StructField("product_type", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("quantity", T.IntegerType()),
    T.StructField("eggs_per_unit", T.IntegerType()),
    T.StructField("unit_price", MONEY),
    T.StructField("line_total", MONEY),
])

EXPENSES = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("expense_date", T.DateType()),
    T.StructField("category", T.StringType()),
    T.StructField("amount", MONEY),
    T.StructField("galpon_id", T.LongType()),
    T.StructField("created_by", T.LongType()),
    T.StructField("farm_id", T.LongType()),
    T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("voided_at", T.TimestampNTZType()),
])

BIRD_EVENTS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("galpon_id", T.LongType()),
    T.StructField("event_date", T.DateType()),
    T.StructField("type", T.StringType()),
    T.StructField("delta", T.IntegerType()),
    T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("voided_at", T.TimestampNTZType()),
])

DOMAIN_SCHEMAS = {
    "galpones": GALPONES,
    "users": USERS,
    "daily_collections": DAILY_COLLECTIONS,
    "sales": SALES,
    "sale_items": SALE_ITEMS,
    "expenses": EXPENSES,
    "bird_events": BIRD_EVENTS,
}

# Offline operation log: one JSON object per line.
OPLOG = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("payload", T.StringType()),
    T.StructField("createdAt", T.StringType()),
    T.StructField("userId", T.LongType()),
    T.StructField("farmId", T.LongType()),
])
# As stored, an operation may name the request it was sent in.
OPLOG_STORED = T.StructType([*OPLOG.fields, T.StructField("requestId", T.StringType())])

# Payloads arrive as text; every field is read as a string and checked by the
# validation operators (coercion rules live there, not in the parser).
COLLECTION_PAYLOAD = T.StructType([
    T.StructField("collectionDate", T.StringType()),
    T.StructField("pequeno", T.StringType()),
    T.StructField("mediano", T.StringType()),
    T.StructField("grande", T.StringType()),
    T.StructField("extraGrande", T.StringType()),
    T.StructField("jumbo", T.StringType()),
    T.StructField("rotos", T.StringType()),
    T.StructField("galponId", T.StringType()),
    T.StructField("notes", T.StringType()),
])

# Items are maps, so that a null field and an absent one can be told apart.
SALE_PAYLOAD = T.StructType([
    T.StructField("saleDate", T.StringType()),
    T.StructField("customer", T.StringType()),
    T.StructField("notes", T.StringType()),
    T.StructField("items", T.ArrayType(T.MapType(T.StringType(), T.StringType()))),
])

EXPENSE_PAYLOAD = T.StructType([
    T.StructField("expenseDate", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("supplier", T.StringType()),
    T.StructField("amount", T.StringType()),
    T.StructField("galponId", T.StringType()),
    T.StructField("notes", T.StringType()),
    # whether the payload names an amount at all; set by the parser
    T.StructField("amountGiven", T.BooleanType()),
])
