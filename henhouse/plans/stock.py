"""Egg stock and bird counts as ledgers over the recorded facts.

Each write of the reference (create / void / edit a collection or sale, manual
stock set, bird movement, bird void) becomes an event of a change log; the fold in
:mod:`henhouse.operators.ledger` replays the log per farm (stock) or per shed
(birds) for all farms and sheds in parallel.

The reference runs one farm; ``farm_id`` is the partition key added so the fold
scales out. It is a column of the facts, apart from their author."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from henhouse import schemas
from henhouse.functions import exprs as X
from henhouse.operators import ledger as L
from henhouse.sources.tables import Tables

SIZES = schemas.CATEGORIES
#: Changes count in the order they were recorded; kind and id order equal times.
ORDER = ["recorded_at", "kind", "op_id"]
K_COLLECTION, K_SALE, K_AMEND, K_VOID, K_SET = 0, 1, 2, 3, 4


def _sized(df: DataFrame, recorded_at, kind: int, op_id, mode: str, deltas: dict, ref=None,
           sets: dict | None = None, alt=None, alt_deltas: dict | None = None) -> DataFrame:
    text = lambda c: c.cast("string") if c is not None else F.lit(None).cast("string")
    cols = [F.col("farm_id"), recorded_at.cast("date").alias("op_date"), recorded_at.alias("recorded_at"),
            F.lit(kind).alias("kind"), op_id.cast("string").alias("op_id"), F.lit(mode).alias("mode"),
            text(ref).alias("ref"), text(alt).alias("alt")]
    cols += [deltas.get(s, F.lit(0)).cast("bigint").alias(f"d_{s}") for s in SIZES]
    cols += [(alt_deltas or {}).get(s, F.lit(0)).cast("bigint").alias(f"a_{s}") for s in SIZES]
    cols += [((sets or {}).get(s, F.lit(None))).cast("bigint").alias(f"v_{s}") for s in SIZES]
    return df.select(*cols)


def collection_events(t: Tables, active_only: bool = False) -> DataFrame:
    dc = t.daily_collections
    if active_only:
        dc = dc.filter(F.col("voided_at").isNull())
    return _sized(dc, F.col("created_at"), K_COLLECTION, F.col("id"), L.ADD, {s: F.col(s) for s in SIZES})


def sale_requirements(t: Tables) -> DataFrame:
    """Eggs required per size by each sale (Σ quantity × eggs per unit)."""
    it = t.sale_items
    return it.groupBy("sale_id").agg(*[
        F.sum(F.when(F.col("category") == s, X.line_eggs("quantity", "eggs_per_unit")).otherwise(F.lit(0)))
        .alias(s) for s in SIZES])


def _sales_with_eggs(t: Tables) -> DataFrame:
    req = sale_requirements(t)
    s = t.sales.select("id", "farm_id", "created_at", "voided_at")
    return s.join(req, s.id == req.sale_id, "inner")


def sale_events(t: Tables) -> DataFrame:
    """Sale creations (mode reject: the whole sale is refused when any size is short)."""
    return _sized(_sales_with_eggs(t), F.col("created_at"), K_SALE, F.col("id"), L.REJECT, {sz: -F.col(sz) for sz in SIZES})


def stock_ops(t: Tables) -> DataFrame:
    """Collections (add) and sales (reject), void flags ignored (FIXTURES.md)."""
    return collection_events(t).unionByName(sale_events(t))


# Edits that the recorded facts do not carry are derived from them: collections of every
# fourth day of the month have their sizes rotated one place, every fifth sale has its
# quantities doubled (even ids) or halved (odd ids), four days after the record.
def _edited_at():
    return F.col("created_at") + F.expr("INTERVAL 4 DAY")


def _edited_collection():
    return F.dayofmonth("collection_date") % 4 == 0


def _new_sizes() -> dict:
    return {SIZES[i]: F.col(SIZES[i - 1]) for i in range(len(SIZES))}


def _edited_sale():
    return F.col("id") % 5 == 0


def _new_eggs(size: str):
    return F.when(F.col("id") % 2 == 0, F.col(size) * 2).otherwise(F.floor(F.col(size) / 2))


def collection_void_events(t: Tables, edits: bool = False) -> DataFrame:
    """Voiding a collection takes its current eggs out again, clamped at zero; with
    ``edits`` these are the eggs after the edit."""
    dc = t.daily_collections.filter(F.col("voided_at").isNotNull())
    current = {s: F.when(_edited_collection(), n).otherwise(F.col(s)) for s, n in _new_sizes().items()} if edits \
        else {s: F.col(s) for s in SIZES}
    return _sized(dc, F.col("voided_at"), K_VOID, F.concat(F.lit("void-"), F.col("id")), L.CLAMP,
                  {s: -c for s, c in current.items()})


def collection_amend_events(t: Tables) -> DataFrame:
    """Edits of collections: the stock moves by new - old per size, clamped at zero
    (amend_delta)."""
    dc = t.daily_collections.filter(_edited_collection())
    return _sized(dc, _edited_at(), K_AMEND, F.concat(F.lit("edit-"), F.col("id")), L.CLAMP,
                  {s: amend_delta(n, F.col(s)) for s, n in _new_sizes().items()})


def amend_delta(new, old):
    """Per-size change of an edit: new - old."""
    return new - old


def sale_void_events(t: Tables, edits: bool = False) -> DataFrame:
    """Voiding a sale gives its eggs back — only if the sale was applied; with ``edits``
    it gives back what an applied edit left of it."""
    j = _sales_with_eggs(t).filter(F.col("voided_at").isNotNull())
    alt = F.when(_edited_sale(), F.concat(F.lit("edit-"), F.col("id").cast("string"))) if edits else None
    return _sized(j, F.col("voided_at"), K_VOID, F.concat(F.lit("void-"), F.col("id").cast("string")), L.RESTORE,
                  {sz: F.col(sz) for sz in SIZES}, ref=F.col("id"), alt=alt,
                  alt_deltas={sz: _new_eggs(sz) for sz in SIZES} if edits else None)


def sale_amend_events(t: Tables) -> DataFrame:
    """Edits of sales: the edit gives back the old eggs and takes the new ones in one
    step; it is refused if the new part is short, or the sale was never applied."""
    j = _sales_with_eggs(t).filter(_edited_sale())
    return _sized(j, _edited_at(), K_AMEND, F.concat(F.lit("edit-"), F.col("id").cast("string")), L.REPLACE,
                  {sz: F.col(sz) - _new_eggs(sz) for sz in SIZES}, ref=F.col("id"))


def stock_set_events(t: Tables) -> DataFrame:
    """Manual stock sets: on each day a farm records an 'Otros' expense, its jumbo
    stock is written down to zero (one size set, the others untouched)."""
    e = (t.expenses.filter((F.col("category") == "Otros") & F.col("voided_at").isNull())
         .groupBy("farm_id", "expense_date").agg(F.max("created_at").alias("created_at")))
    return _sized(e, F.col("created_at"), K_SET,
                  F.concat(F.lit("set-"), F.col("farm_id").cast("string"), F.lit("-"), F.col("expense_date").cast("string")),
                  L.SET, {}, sets={"jumbo": F.lit(0)})


def stock_log(t: Tables) -> DataFrame:
    """Every change of the stock: collections and sales, their edits and voids, and
    manual sets."""
    log = stock_ops(t)
    for more in (collection_amend_events(t), collection_void_events(t, edits=True), sale_amend_events(t),
                 sale_void_events(t, edits=True), stock_set_events(t)):
        log = log.unionByName(more)
    return log


def run(events: DataFrame, modes: set[str], **options) -> DataFrame:
    refs = {"ref_col": "ref", "alt_col": "alt"} if modes & {L.RESTORE, L.REPLACE} else {}
    if not refs:
        events = events.drop("ref", "alt", *[f"a_{s}" for s in SIZES])
    if L.SET not in modes:
        events = events.drop(*[f"v_{s}" for s in SIZES])
    return L.fold(events, "farm_id", ORDER, SIZES, modes, chunk="op_date", **refs, **options)


def stock_running(t: Tables) -> DataFrame:
    """Collections only (mode add): running stock per farm (associative plan)."""
    return run(collection_events(t, active_only=True), {L.ADD})


def stock_with_sales(t: Tables) -> DataFrame:
    return run(stock_ops(t), {L.ADD, L.REJECT})


def stock_with_collection_voids(t: Tables) -> DataFrame:
    """Collections, sales and voided collections: what was sold already is not there to
    be taken out, so the clamp acts."""
    return run(stock_ops(t).unionByName(collection_void_events(t)), {L.ADD, L.REJECT, L.CLAMP})


def stock_with_collection_amends(t: Tables) -> DataFrame:
    return run(stock_ops(t).unionByName(collection_amend_events(t)), {L.ADD, L.REJECT, L.CLAMP})


def stock_with_sale_voids(t: Tables) -> DataFrame:
    return run(stock_ops(t).unionByName(sale_void_events(t)), {L.ADD, L.REJECT, L.RESTORE})


def stock_with_sale_amends(t: Tables) -> DataFrame:
    return run(stock_ops(t).unionByName(sale_amend_events(t)), {L.ADD, L.REJECT, L.REPLACE})


def stock_with_sets(t: Tables) -> DataFrame:
    return run(stock_ops(t).unionByName(stock_set_events(t)), {L.ADD, L.REJECT, L.SET})


def stock_full(t: Tables) -> DataFrame:
    """The fold of the whole log."""
    return run(stock_log(t), {L.ADD, L.REJECT, L.CLAMP, L.RESTORE, L.REPLACE, L.SET})


def low_stock_crossings(folded: DataFrame, threshold: int = schemas.LOW_STOCK_THRESHOLD) -> DataFrame:
    """Sizes a sale creation took from >= threshold to < threshold (one notice each;
    edits never notify)."""
    sale = folded.filter((F.col("kind") == K_SALE) & F.col("applied"))
    long = sale.select("farm_id", "op_date", "op_id", F.explode(F.array(*[
        F.struct(F.lit(s).alias("category"), F.col(f"d_{s}").alias("d"), F.col(f"before_{s}").alias("before"),
                 F.col(f"after_{s}").alias("remaining")) for s in SIZES])).alias("c"))
    return long.filter((F.col("c.d") < 0) & (F.col("c.before") >= threshold) & (F.col("c.remaining") < threshold)) \
        .select("farm_id", "op_date", "op_id", "c.category", "c.remaining")


def inventory(folded: DataFrame) -> DataFrame:
    """Current stock per farm and size (the last state of each farm's fold), in enum
    order."""
    last = folded.groupBy("farm_id").agg(F.max_by(F.struct(*[F.col(f"after_{s}").alias(s) for s in SIZES]), F.struct(*ORDER)).alias("st"))
    return inventory_of(last)


def inventory_of(states: DataFrame, *more: str) -> DataFrame:
    """The rows of the stock screen, of one state (struct st) per farm."""
    long = states.select("farm_id", *more, F.explode(F.array(*[
        F.struct(F.lit(s).alias("category"), F.col(f"st.{s}").alias("quantity")) for s in SIZES])).alias("c"))
    return long.select("farm_id", "c.category", "c.quantity",
                       X.category_rank("c.category").alias("category_rank"),
                       X.crates_equiv("c.quantity").alias("crates"), *more) \
        .orderBy("farm_id", "category_rank")


def inventory_totals(inv: DataFrame) -> DataFrame:
    """Σ quantity, largest size (bar scale, at least 1) per farm."""
    return inv.groupBy("farm_id").agg(F.sum("quantity").alias("total_eggs"),
                                      F.greatest(F.lit(1), F.max("quantity")).cast("bigint").alias("max_quantity"))


# -- birds ---------------------------------------------------------------------------
BIRD_ORDER = ["event_date", "created_at", "kind", "op_id"]


def bird_ops(t: Tables, with_voids: bool) -> DataFrame:
    """Bird movements per shed: arrivals add, deaths and adjustments are refused when the
    count would go below zero; a void takes the delta of an applied movement back,
    clamped, on its day in the farm's zone."""
    ev = t.bird_events
    base = ev.select(
        F.col("galpon_id"), "event_date", "created_at", F.lit(0).alias("kind"),
        F.col("id").cast("string").alias("op_id"),
        F.when(F.col("type") == "ingreso", F.lit(L.ADD)).otherwise(F.lit(L.REJECT)).alias("mode"),
        F.lit(None).cast("string").alias("ref"), F.col("delta").cast("bigint").alias("d_birds"))
    if not with_voids:
        return base.drop("ref")
    voids = ev.filter(F.col("voided_at").isNotNull()).select(
        "galpon_id", (F.col("voided_at") - F.expr("INTERVAL 6 HOUR")).cast("date").alias("event_date"),
        F.col("voided_at").alias("created_at"),
        F.lit(1).alias("kind"), F.concat(F.lit("void-"), F.col("id").cast("string")).alias("op_id"),
        F.lit(L.CLAMP).alias("mode"), F.col("id").cast("string").alias("ref"), (-F.col("delta")).cast("bigint").alias("d_birds"))
    return base.unionByName(voids)


def opening_counts(t: Tables) -> DataFrame:
    """The count each shed was created with: what its stored count has besides the active
    movements (at least 0)."""
    moved = t.bird_events.filter(F.col("voided_at").isNull()).groupBy("galpon_id").agg(F.sum("delta").alias("moved"))
    return (t.galpones.select(F.col("id").alias("galpon_id"), "bird_count").join(moved, "galpon_id", "left")
            .select("galpon_id", F.greatest(F.lit(0), F.col("bird_count") - F.coalesce("moved", F.lit(0))).cast("bigint").alias("birds")))


def bird_fold(t: Tables, with_voids: bool) -> DataFrame:
    modes = {L.ADD, L.REJECT} | ({L.CLAMP} if with_voids else set())
    return L.fold(bird_ops(t, with_voids), "galpon_id", BIRD_ORDER, ["birds"], modes, chunk="event_date",
                  ref_col="ref" if with_voids else None, initial=opening_counts(t))


def bird_adjustments(t: Tables, folded: DataFrame) -> DataFrame:
    """Setting each shed to its stored bird_count emits an 'ajuste' event with
    delta = new - current (none when equal)."""
    cur = folded.groupBy("galpon_id").agg(F.max_by("after_birds", F.struct(*BIRD_ORDER)).alias("current"))
    g = t.galpones.select(F.col("id").alias("galpon_id"), F.col("bird_count").cast("bigint").alias("target"))
    j = g.join(cur, "galpon_id", "left").join(opening_counts(t), "galpon_id").select(
        "galpon_id", F.coalesce("current", "birds").alias("current"), "target")
    return (j.withColumn("delta", F.col("target") - F.col("current"))
            .filter(F.col("delta") != 0)
            .withColumn("type", F.lit("ajuste")).withColumn("reason", F.lit("Ajuste manual")))
