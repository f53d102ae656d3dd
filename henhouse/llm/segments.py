"""Runs of consecutive windows that share a minimiser, cut, shipped and joined back.

To find equal windows of a fixed length in all documents, each window is assigned to the
bucket of its minimiser (the least hash among the short grams inside it). Equal windows
have equal minimisers, so they meet in one bucket, and consecutive windows mostly share
one, so they travel together as one string, a segment. What a bucket finds comes back as
ranges of places of a document.

Segments that are equal byte for byte are one: the occurrence that starts first stands
for them, and the others' windows are known repeats at once. This is done where segments
are cut and again whenever a bucket's memory fills, so a text that a third of all rows
share costs a bucket one segment for each block of input at most.

A minimiser that many documents share between different neighbours gives as many distinct
segments. A bucket with more of them than its memory is meant for is not settled there: its
windows are written with their content, Spark finds the first of each content, and the
others are joined to it, so such a bucket is spread by its windows."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from henhouse.llm.common import NULL_ID, extent, keyed_texts, written
from henhouse.llm.words import Texts, blocks, mix

#: Bytes of text cut at once, and bytes of segments a bucket gathers before it joins equal ones.
CUT_BYTES, GATHER_BYTES = 2 << 20, 12 << 20
#: Bytes of segments aimed at in a bucket; with about 3.3 bytes of segment for each of text.
BUCKET_BYTES, GROWTH = 8 << 20, 3.3
#: Bytes of distinct segments in a bucket above which its windows are dealt out one by one.
HOT_BYTES = 3 * BUCKET_BYTES
RANGES = "doc_id long, tie long, low long, high long"
_CODEC = pa.Codec("zstd", compression_level=5)


def squeezed(raw: bytes) -> bytes:
    return struct.pack("<I", len(raw)) + _CODEC.compress(raw, asbytes=True)


def restored(blob: bytes) -> bytes:
    return _CODEC.decompress(blob[4:], struct.unpack_from("<I", blob)[0], asbytes=True)


def slices(sizes: np.ndarray, most: int = CUT_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive items whose sizes make up about ``most``: first and end of each slice."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        done = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + most, "right")))
        yield at, to
        at = to


@dataclass
class Segments:
    """Segment i: ``windows[i]`` windows, the first at place ``start[i]`` of its document;
    its minimiser ``off[i]`` bytes in (-1: it occurs more than once); ``text[i]`` its bytes."""

    doc: np.ndarray
    tie: np.ndarray
    start: np.ndarray
    windows: np.ndarray
    off: np.ndarray
    text: list[bytes]

    NUMBERS = (("doc", "<i8"), ("tie", "<i8"), ("start", "<i8"), ("windows", "<i4"), ("off", "<i2"))

    def sizes(self) -> np.ndarray:
        return np.fromiter(map(len, self.text), np.int64, len(self.text))

    def take(self, which: np.ndarray) -> Segments:
        return Segments(*[getattr(self, n)[which] for n, _ in self.NUMBERS], [self.text[i] for i in which.tolist()])

    @staticmethod
    def joined(parts: list[Segments]) -> Segments:
        return Segments(*[np.concatenate([getattr(p, n) for p in parts]) for n, _ in Segments.NUMBERS],
                        [t for p in parts for t in p.text])

    def packed(self) -> bytes:
        sizes = self.sizes().astype("<u4")
        raw = b"".join([struct.pack("<I", len(self.text)), *[getattr(self, n).astype(t).tobytes() for n, t in self.NUMBERS],
                        sizes.tobytes(), *self.text])
        return squeezed(raw)

    @staticmethod
    def unpacked(blob: bytes) -> Segments:
        raw = restored(blob)
        n, at, cols = struct.unpack_from("<I", raw)[0], 4, []
        for _, kind in (*Segments.NUMBERS, ("", "<u4")):
            cols.append(np.frombuffer(raw, kind, n, at))
            at += cols[-1].nbytes
        ends = (np.cumsum(cols.pop()) + at).tolist()
        return Segments(*cols, [raw[a:b] for a, b in zip([at, *ends], ends)])


def compacted(segments: Segments, window: int) -> tuple[Segments, pa.RecordBatch, np.ndarray]:
    """Equal segments as their first occurrence, the ranges of the others, and which stay."""
    order = np.lexsort((segments.start, segments.tie, segments.doc))
    segments = segments.take(order)
    first: dict[bytes, int] = {}
    leader = np.fromiter((first.setdefault(t, i) for i, t in enumerate(segments.text)), np.int64, len(order))
    alone = leader == np.arange(len(order))
    rest = np.flatnonzero(~alone)
    same = np.logical_and.reduce([getattr(segments, n)[rest] == getattr(segments, n)[leader[rest]] for n in ("doc", "tie", "start")])
    rest = rest[~same]  # a document seen twice is no repeat of itself
    low = segments.start[rest]
    stays = np.flatnonzero(alone)
    return segments.take(stays), ranges(
        segments.doc[rest], segments.tie[rest], low, low + segments.windows[rest] - 1 + window), order[stays]


def ranges(doc: np.ndarray, tie: np.ndarray, low: np.ndarray, high: np.ndarray) -> pa.RecordBatch:
    """Ranges as a batch; those of one document that touch or overlap are joined."""
    order = np.lexsort((low, tie, doc))
    doc, tie, low, high = doc[order], tie[order], low[order].astype(np.int64), high[order].astype(np.int64)
    if len(doc):
        fresh = np.ones(len(doc), bool)
        fresh[1:] = (doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1])
        group = np.cumsum(fresh) - 1
        lift = group * (int(high.max()) + 1)  # a running maximum that starts anew with each document
        top = np.maximum.accumulate(high + lift) - lift
        fresh[1:] |= low[1:] > top[:-1]
        at = np.flatnonzero(fresh)
        doc, tie, low, high = doc[at], tie[at], low[at], top[np.append(at[1:], len(top)) - 1]
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in (doc, tie, low, high)],
                                      ["doc_id", "tie", "low", "high"])


def sliding_min(keys: np.ndarray, n: int) -> np.ndarray:
    """The least of each ``n`` consecutive keys."""
    least, span = keys, 1
    while span * 2 <= n:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    return np.minimum(least[:len(keys) - n + 1], least[n - span:]) if n > span else least


def runs(valid: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and number of the windows of each run: ``valid`` are the windows' places in
    ascending order, ``value`` their minimisers; a run has adjacent places and one value."""
    fresh = np.ones(len(valid), bool)
    fresh[1:] = (valid[1:] != valid[:-1] + 1) | (value[1:] != value[:-1])
    at = np.flatnonzero(fresh)
    return at, np.diff(np.append(at, len(valid)))


#: Cuts a block of texts: (first window of each segment, its place in its document, windows,
#: off, minimiser, text number, bytes).
Cut = Callable[[Texts], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]]
#: First and end byte of each window of a segment.
Bounds = Callable[[bytes], tuple[np.ndarray, np.ndarray]]


def repeats(docs: DataFrame, window: int, cut: Cut, settle: Callable[[Segments], Iterator[pa.RecordBatch]],
            *carried: Column, bounds: Bounds, hot_bytes: int = HOT_BYTES) -> tuple[DataFrame, DataFrame]:
    """The documents (doc_id, tie, text, and ``carried``) and the ranges of places covered
    by windows that start earlier elsewhere. ``settle`` gets a bucket's distinct segments
    and yields the ranges of the windows that are not the first of their kind; ``bounds``
    gives the windows of a segment of a bucket with more than ``hot_bytes`` of them."""
    spark = docs.sparkSession
    unique, size = extent(docs)
    buckets = max(1, round(size * GROWTH / BUCKET_BYTES))
    texts = keyed_texts(docs, unique, *carried).withColumn("doc_id", F.coalesce("doc_id", F.lit(NULL_ID)))

    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids, ties = (np.asarray(batch.column(c)) for c in ("doc_id", "tie"))
            for at, end, block in blocks(batch, size=CUT_BYTES):
                start, windows, off, least, text_no, text = cut(block)
                if not len(start):
                    continue
                own = Segments(doc_ids[at:end][text_no], ties[at:end][text_no], start, windows, off, text)
                own, known, stays = compacted(own, window)
                bucket = (mix(least[stays]) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                own, bucket = own.take(order), bucket[order]
                edges = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
                names = bucket[edges[:-1]].tolist()
                blobs = [own.take(np.arange(a, b)).packed() for a, b in zip(edges, edges[1:])]
                if known.num_rows:  # travels along with a bucket, as the exchange is the same
                    names.append(names[at % len(names)])
                    blobs.append(_KNOWN + _packed_ranges(known))
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "blob"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held, bytes_held, hot = None, [], 0, False

        def ended() -> Iterator[pa.RecordBatch]:
            def last(kept: Segments) -> Iterator[pa.RecordBatch]:
                return _contents(kept, window, bounds) if hot or int(kept.sizes().sum()) > hot_bytes else settle(kept)

            return _settled(held, window, last) if held else iter(())

        for batch in batches:
            for name, blob in zip(batch.column("bucket").to_pylist(), batch.column("blob").to_pylist()):
                if name != bucket:
                    yield from map(_full, ended())
                    held, bytes_held, hot = [], 0, False
                bucket = name
                if blob[:4] == _KNOWN:
                    yield _full(_unpacked_ranges(blob[4:]))
                    continue
                held.append(Segments.unpacked(blob))
                bytes_held += sum(map(len, held[-1].text))
                if bytes_held > min(GATHER_BYTES, hot_bytes):
                    kept, again, _ = compacted(Segments.joined(held), window)
                    yield _full(again)
                    size = sum(map(len, kept.text))
                    hot = hot or size > hot_bytes
                    if hot:
                        yield from map(_full, _contents(kept, window, bounds))
                        held, bytes_held = [], 0
                        continue
                    held = [kept]
                    # distinct segments may fill the memory: gather as much again before the next try
                    bytes_held = min(size, min(GATHER_BYTES, hot_bytes) // 2)
        yield from map(_full, ended())

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = written(texts.select("doc_id", "tie", "text").mapInArrow(ship, "bucket long, blob binary")
                    .repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(search, RANGES + ", content binary"), "ranges")
    hot = found.filter(F.col("content").isNotNull())
    found = found.filter(F.col("content").isNull()).drop("content")
    return texts, found if hot.isEmpty() else found.union(_later(hot))


def _contents(segments: Segments, window: int, bounds: Bounds) -> Iterator[pa.RecordBatch]:
    """The windows of ``segments``, each with its bytes."""
    for a, b in slices(segments.windows.astype(np.int64) * window, CUT_BYTES // 4):
        text = segments.text[a:b]
        spans = [bounds(t) for t in text]
        n = segments.windows[a:b].astype(np.int64)
        low = np.concatenate([segments.start[i] + np.arange(segments.windows[i]) for i in range(a, b)]).astype(np.int64)
        content = [t[x:y] for t, (first, end) in zip(text, spans) for x, y in zip(first.tolist(), end.tolist())]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(segments.doc[a:b], n).astype(np.int64)), pa.array(np.repeat(segments.tie[a:b], n).astype(np.int64)),
             pa.array(low), pa.array(low + window), pa.array(content, pa.binary())], ["doc_id", "tie", "low", "high", "content"])


def _full(found: pa.RecordBatch) -> pa.RecordBatch:
    if found.num_columns == 5:
        return found
    return pa.RecordBatch.from_arrays([*found.columns, pa.nulls(found.num_rows, pa.binary())], [*found.schema.names, "content"])


def _later(hot: DataFrame) -> DataFrame:
    """The ranges of the windows with a content that starts earlier elsewhere."""
    place = F.struct("doc_id", "tie", "low")
    first = hot.groupBy("content").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter(F.col("first") < F.col("last"))
    return hot.join(first, "content").filter(place > F.col("first")).select("doc_id", "tie", "low", "high")


#: Leads a blob of ranges; a blob of segments leads with its size, which is never this large.
_KNOWN = b"\xff\xff\xff\xff"


def _packed_ranges(found: pa.RecordBatch) -> bytes:
    return squeezed(b"".join(np.asarray(c).astype("<i8").tobytes() for c in found.columns))


def _unpacked_ranges(blob: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in np.frombuffer(restored(blob), "<i8").reshape(4, -1)],
                                      ["doc_id", "tie", "low", "high"])


def _settled(held: list[Segments], window: int, settle) -> Iterator[pa.RecordBatch]:
    kept, again, _ = compacted(Segments.joined(held), window)
    yield again
    yield from settle(kept)


def with_ranges(texts: DataFrame, found: DataFrame) -> DataFrame:
    """``texts`` with the text compressed (``packed``) and ``spans``: the ranges of each
    document, as low << 32 | high. Texts cross the exchange of this join compressed; read
    them with ``with_texts``."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            blobs = [squeezed(t) for t in batch.column(at).cast(pa.binary()).to_pylist()]
            yield batch.set_column(at, "packed", pa.array(blobs, pa.binary()))

    fields = ", ".join("packed binary" if f.name == "text" else f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema)
    packed = F.shiftleft(F.col("low"), 32).bitwiseOR(F.col("high")).alias("span")
    spans = found.select("doc_id", "tie", packed).groupBy("doc_id", "tie").agg(F.collect_list("span").alias("spans"))
    # few ranges would be broadcast, and each task hold a worker that packs and one that reads
    return texts.mapInArrow(pack, fields).join(spans.hint("merge"), ["doc_id", "tie"], "left")


def with_texts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of ``batch`` with the bytes of the text in place of ``packed``."""
    at = batch.schema.get_field_index("packed")
    blobs = batch.column(at).to_pylist()
    sizes = np.fromiter((struct.unpack_from("<I", b)[0] for b in blobs), np.int64, len(blobs))
    for a, b in slices(sizes):
        texts = [restored(z) for z in blobs[a:b]]
        yield batch.slice(a, b - a).set_column(at, "text", pa.array(texts, pa.binary()))


def marked(spans: pa.Array, bounds: np.ndarray) -> np.ndarray:
    """Which places are covered: ``spans`` are the lists of ranges of consecutive texts,
    whose places begin at ``bounds``."""
    lists = spans.fill_null([]) if spans.null_count else spans
    flat = np.asarray(lists.flatten()).astype(np.int64)
    base = np.repeat(bounds[:-1], np.asarray(pa.compute.list_value_length(lists)))
    edge = np.zeros(int(bounds[-1]) + 1, np.int64)
    np.add.at(edge, base + (flat >> 32), 1)
    np.subtract.at(edge, base + (flat & 0xFFFFFFFF), 1)
    return np.cumsum(edge)[:-1] > 0
