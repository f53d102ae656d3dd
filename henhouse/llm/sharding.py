"""Sharding by histogram sort.

Documents are ordered by (hash of the text, doc_id, row), which scatters sources and
lengths but keeps equal texts side by side. Splitters of that order are found by
counting: every round sums, over all rows, the exact bytes below a few candidate keys
per splitter, keeps the interval that holds the wanted byte count and divides it anew,
until each splitter is within the tolerance or no key lies between its bounds. The
interval starts on the hash alone; if one hash (a group of equal texts) holds more
bytes than the tolerance allows, the search goes on among its doc_ids and then its
rows, so even a third of all rows with one text is cut evenly; smaller groups stay in
one shard. Rounds read a narrow written table (no texts) and send a few sums to the
driver; the documents themselves are exchanged once, by ``write_shards``.

Defined results: a null text has no bytes (size 1); a null doc_id sorts first; rows
equal in doc_id and text are told apart by their place in the input; an empty table
gives an empty result; other columns are ignored or, in ``write_shards``, carried.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from henhouse.llm.common import written
from henhouse.llm.ranks import ranked

KEY = ("text_hash", "id", "row")
LOW, HIGH = -(1 << 63), (1 << 63) - 1


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the sort key of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("text_hash"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LOW)).alias("id"),
        F.monotonically_increasing_id().alias("row"))


Bound = tuple[int, int, int]
Spans = tuple[tuple[int, int], ...]


def below(bound: Bound) -> Column:
    """Whether a row's key sorts below ``bound``."""
    h, i, r = (F.col(k) for k in KEY)
    if bound[1:] == (LOW, LOW):
        return h < bound[0]
    return (h < bound[0]) | ((h == bound[0]) & ((i < bound[1]) | ((i == bound[1]) & (r < bound[2]))))


@dataclass(frozen=True)
class _Range:
    """Rows among which a splitter lies: keys from ``lower`` up to ``upper`` (None: no end),
    with ``before`` bytes below them; ``spans`` has the least and greatest value of each
    part of their keys. Two ranges are the same or have no key in common."""

    lower: Bound
    upper: Bound | None
    before: int
    spans: Spans

    def probes(self, n: int) -> list[Bound]:
        """Bounds that divide the span of the first part in which the rows differ."""
        prefix: tuple[int, ...] = ()
        for low, high in self.spans:
            if low < high:
                n = min(n, high - low)
                cuts = [low + -(-(high - low) * i // n) for i in range(1, n + 1)]
                return [(*prefix, c, LOW, LOW)[:len(KEY)] for c in cuts]
            prefix += (low,)
        return []


def _narrowed(at: _Range, target: float, tolerance: float, buckets: list[tuple[Bound | None, int, Spans | None]]) -> Bound | _Range:
    """The splitter, if a bound of ``buckets`` is near enough or no key is left to divide
    by; else the bucket it lies in. A bucket: its upper bound, bytes, spans."""
    lower, before = at.lower, at.before
    for upper, size, spans in buckets:
        after = before + size
        if upper is not None and abs(after - target) <= tolerance:
            return upper
        if after >= target and spans:
            if all(low == high for low, high in spans):  # one row: the nearer of its sides
                h, i, r = (low for low, _ in spans)
                return (h, i, r) if target - before <= after - target else (h, i, r + 1)
            return _Range(lower, upper, before, spans)
        lower, before = upper or lower, after
    return HIGH, HIGH, HIGH


def splitters(rows: DataFrame, shards: int, tolerance: float = 0.002, probes: int = 16) -> list[Bound]:
    """``shards`` - 1 ascending bounds of the key; shard i holds the keys from bound i - 1
    up to, but without, bound i. ``tolerance`` is a share of a shard's even size."""
    stats = [F.sum("size").alias("bytes")] + [
        f(k).alias(f"{n}_{k}") for k in KEY for n, f in (("least", F.min), ("most", F.max))]
    spans = lambda r: tuple((r[f"least_{k}"], r[f"most_{k}"]) for k in KEY)
    whole = rows.agg(*stats).first()
    total = whole["bytes"] or 0
    start = _Range((LOW, LOW, LOW), None, 0, spans(whole))
    lying: dict[float, Bound | _Range] = {total * i / shards: start for i in range(1, shards)} if total else {}
    while open_ := {r for r in lying.values() if isinstance(r, _Range)}:
        own = {r: r.probes(probes) for r in open_}
        bounds = sorted({b for r, bs in own.items() for b in (r.lower, *bs, r.upper) if b is not None})
        passed = sum((F.when(below(b), 0).otherwise(1) for b in bounds), F.lit(0))
        counted = {r["passed"]: r for r in rows.groupBy(passed.alias("passed")).agg(*stats).collect()}
        parts = {}
        for r, bs in own.items():
            first = bounds.index(r.lower) + 1
            found = [counted.get(first + j) for j in range(len(bs) + 1)]
            parts[r] = [(u, c["bytes"] if c else 0, spans(c) if c else None) for u, c in zip([*bs, r.upper], found)]
        lying = {t: _narrowed(r, t, tolerance * total / shards, parts[r]) if isinstance(r, _Range) else r
                 for t, r in lying.items()}
    return sorted(lying.values()) or [(HIGH, HIGH, HIGH)] * (shards - 1)


def shard_of(bounds: list[Bound]) -> Column:
    return sum((F.when(below(b), 0).otherwise(1) for b in bounds), F.lit(0)).cast("int")


def shards_by_bytes(docs: DataFrame, shards: int = 8, tolerance: float = 0.002) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard and slot (its place in the
    shard by the sort key, from 0)."""
    rows = written(sized(docs), "shard-sizes")
    placed = rows.withColumn("shard", shard_of(splitters(rows, shards, tolerance)))
    return (ranked(placed, "shard", list(KEY), "shard-slots")
            .select("doc_id", "size", "text_crc32", "shard", F.col("rank").alias("slot")))


def write_shards(docs: DataFrame, path: str, shards: int = 8, tolerance: float = 0.002,
                 files_per_shard: int = 1) -> None:
    """Writes ``docs``, all columns, as folders ``shard=0`` ... in one exchange; inside a
    file rows are in the order of the key. A column named shard must not exist."""
    if "shard" in docs.columns:
        raise ValueError("docs already has a column named shard")
    key = sized(docs).columns
    full = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("rec"),
                       *[c.alias(n) for n, c in zip(KEY, (
                           F.xxhash64(F.coalesce(F.col("text"), F.lit(""))),
                           F.coalesce(F.col("doc_id").cast("long"), F.lit(LOW)),
                           F.monotonically_increasing_id()))])
    bounds = splitters(written(sized(docs).select("size", *[k for k in key if k in KEY]), "shard-sizes"),
                       shards, tolerance)
    (full.withColumn("shard", shard_of(bounds))
     .repartitionByRange(shards * files_per_shard, "shard", *KEY).sortWithinPartitions("shard", *KEY)
     .select("rec.*", "shard").write.partitionBy("shard").parquet(path))
