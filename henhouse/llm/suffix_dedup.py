"""Substring de-duplication over bytes by a threshold-bounded LCP construction.

A string here is ``WINDOW`` consecutive bytes of one document. Documents are cut into
segments by the minimiser of each string (``segments``), so equal strings meet in one
bucket. Segments that are equal byte for byte have become one by then. What is left to
find lies in distinct segments that share a minimiser and at least half of the string on
one side of it; these are laid end to end and indexed:

- suffixes are sorted by their first 128 bytes (prefix doubling), which gives the
  Burrows-Wheeler transform and its LF mapping;
- starting from the interval of the empty string, all intervals of strings of one length
  are extended backward by one byte, breadth first. An interval whose right border has no
  common-prefix value yet fixes it to the current length and lives on; others end. Values
  thus appear in increasing order, and the search stops at ``WINDOW``: borders without a
  value then are those whose suffixes share ``WINDOW`` bytes or more.

Runs between borders with a value are the groups of equal strings. In each, all but the
one that starts first (smaller doc_id, then place) mark their bytes; the marks are joined
with the text once.

Defined results: a null text is empty; documents shorter than a string keep every byte;
rows that share a doc_id but not the text are ordered by a hash of the text; rows equal in
both are one document seen twice and no repeats of each other; a null doc_id comes before
all others; an empty table gives an empty result; other columns are ignored. Bytes may be
cut inside a character: the digest is of the bytes, ``kept_text`` drops such remains.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from henhouse.llm.common import NULL_ID
from henhouse.llm.segments import Segments, marked, ranges, repeats, runs, slices, sliding_min, with_ranges, with_texts
from henhouse.llm.words import Texts, blocks, mix, prefix_sums, span_hash

WINDOW, GRAM = 100, 16
#: Bytes indexed together; a single group of segments that share a minimiser may be larger.
INDEX_BYTES = 1 << 20
#: Stands between segments; no byte of UTF-8.
END = 0xFF
PLACE_BITS = np.uint64(31)


def load8(data: np.ndarray, n: int, big: bool = False) -> np.ndarray:
    """For each of the first ``n`` places the 8 bytes from there as a uint64 (zeros past the end)."""
    padded = np.zeros(n + 16, np.uint8)
    padded[:min(len(data), n + 8)] = data[:n + 8]
    out = np.empty(n + 8, np.uint64)
    for r in range(8):
        part = padded[r:r + (n + 8 - r) // 8 * 8].view(">u8" if big else "<u8")
        out[r:r + 8 * len(part):8] = part
    return out[:n]


def cutter(window: int, gram: int):
    if gram != 16:
        raise ValueError("grams are 16 bytes")

    def cut(texts: Texts):
        none = np.zeros(0, np.int64)
        size = len(texts.data)
        whole = np.maximum(np.diff(texts.bounds) - window + 1, 0)
        if not whole.sum():
            return none, none, none, none.astype(np.uint64), none, []
        heads = load8(texts.data, size)
        tails = np.zeros_like(heads)
        tails[:-8] = heads[8:]
        with np.errstate(over="ignore"):
            keys = mix(mix(heads) * np.uint64(0x9FB21C651E98DF25) + tails)
        del heads, tails
        keys = keys >> PLACE_BITS << PLACE_BITS | np.arange(size, dtype=np.uint64)
        least = sliding_min(keys[:size - gram + 1], window - gram + 1)
        del keys
        edge = np.zeros(size + 1, np.int32)
        full = whole > 0
        edge[texts.bounds[:-1][full]] += 1
        edge[texts.bounds[:-1][full] + whole[full]] -= 1
        valid = np.flatnonzero(np.cumsum(edge[:-1], dtype=np.int32))
        del edge
        least = least[valid]
        value = least >> PLACE_BITS
        first, count = runs(valid, value)
        place = (least & np.uint64((1 << int(PLACE_BITS)) - 1)).astype(np.int64)
        begin, end = valid[first], valid[first] + count - 1 + window
        off = np.where(place[first] == place[first + count - 1], place[first] - begin, -1)
        no = np.searchsorted(texts.bounds, begin, "right") - 1
        data = texts.data.tobytes()
        text = [data[a:b] for a, b in zip(begin.tolist(), end.tolist())]
        return begin - texts.bounds[no], count, off, value[first], no, text
    return cut


def bounds_of(window: int):
    def bounds(text: bytes) -> tuple[np.ndarray, np.ndarray]:
        first = np.arange(len(text) - window + 1)
        return first, first + window
    return bounds


def candidates(segments: Segments, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Which segments may hold a string that another place of the bucket also holds, and
    the minimiser of each: strings of ``window`` bytes around the same minimiser share at
    least half of what is left of them on its left or on its right."""
    sizes = segments.sizes()
    half = (window - gram) // 2
    single = segments.off >= 0
    may, core = ~single, np.zeros(len(sizes), np.uint64)
    keys, owners = ([], []), ([], [])
    for a, b in slices(sizes):
        ends = np.cumsum(sizes[a:b])
        begin = ends - sizes[a:b]
        off = segments.off[a:b]
        sums = prefix_sums(np.frombuffer(b"".join(segments.text[a:b]), np.uint8))
        at = begin + np.maximum(off, 0)
        core[a:b] = span_hash(sums, at, np.minimum(at + gram, ends))
        for side, (low, high, fits) in enumerate(((at - half, at + gram, off >= half), (at, at + gram + half, at + gram + half <= ends))):
            which = np.flatnonzero(single[a:b] & fits)
            keys[side].append(span_hash(sums, low[which], high[which]))
            owners[side].append(which + a)
    for key, which in zip(map(np.concatenate, keys), map(np.concatenate, owners)):
        _, back, n = np.unique(key, return_inverse=True, return_counts=True)
        may[which[n[back] > 1]] = True
    # a minimiser that occurs twice inside one segment: keep all segments that have it
    if (~single).any():
        core = np.where(single, core, 0)
        many = np.flatnonzero(~single)
        inside = np.unique(np.concatenate([_grams(segments.text[i], gram) for i in many.tolist()]))
        may |= single & np.isin(core, inside)
    return np.flatnonzero(may), core


def _grams(text: bytes, gram: int) -> np.ndarray:
    sums = prefix_sums(np.frombuffer(text, np.uint8))
    starts = np.arange(len(text) - gram + 1)
    return span_hash(sums, starts, starts + gram)


def sorted_suffixes(data: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` bytes at least (a power of two of 8
    and more), shorter ones first."""
    n = len(data)
    keys = load8(data, n, big=True)
    order = np.argsort(keys, kind="stable")
    rank, span = np.empty(n, np.int64), 8
    ranked = np.concatenate(([0], np.cumsum(keys[order][1:] != keys[order][:-1])))
    rank[order] = ranked
    while span < depth and ranked[-1] < n - 1:
        after = np.zeros(n, np.int64)
        after[:max(0, n - span)] = rank[span:] + 1
        keys = rank.astype(np.uint64) << np.uint64(32) | after.astype(np.uint64)
        order = np.argsort(keys, kind="stable")
        ranked = np.concatenate(([0], np.cumsum(keys[order][1:] != keys[order][:-1])))
        rank = np.empty(n, np.int64)
        rank[order] = ranked
        span *= 2
    return order


def long_borders(data: np.ndarray, suffixes: np.ndarray, window: int) -> np.ndarray:
    """For each place in the suffix order but the first: whether its suffix and the one
    before share ``window`` bytes or more."""
    n = len(data)
    last = data[suffixes - 1]  # the transform; the text is read as a ring
    lf = np.empty(n, np.int64)
    lf[np.argsort(last, kind="stable")] = np.arange(n)
    # a stretch of the transform with one byte extends to one interval
    stretch = np.concatenate(([0], np.cumsum(last[1:] != last[:-1])))
    known = np.zeros(n + 1, bool)  # known[i]: the border before place i has its value
    known[0] = known[n] = True
    low, high = np.array([0]), np.array([n - 1])
    for length in range(window):
        even = stretch[low] == stretch[high]
        one_low, one_high = lf[low[even]], lf[high[even]]
        a, b = low[~even], high[~even]
        sizes = b - a + 1
        of = np.repeat(np.arange(len(a)), sizes)
        places = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + a[of]
        key = of * 256 + last[places]
        order = np.argsort(key, kind="stable")
        key, to = key[order], lf[places[order]]
        fresh = np.ones(len(key), bool)
        fresh[1:] = key[1:] != key[:-1]
        at = np.flatnonzero(fresh)
        low = np.concatenate((one_low, to[at]))
        high = np.concatenate((one_high, to[np.append(at[1:], len(to)) - 1] if len(at) else to))
        # the strings of low..high have length + 1 bytes; a new border shares ``length``
        lives = ~known[high + 1]
        lives |= high + 1 == n  # the last interval has no border to fix, but extends
        known[high[lives] + 1] = True
        known[n] = True
        low, high = low[lives], high[lives]
        if not len(low):
            break
    return ~known[1:n]


def settler(window: int, gram: int):
    def settle(segments: Segments) -> Iterator[pa.RecordBatch]:
        """The ranges of the strings that are not the first of their kind in the bucket."""
        if not segments.text:
            return
        which, core = candidates(segments, window, gram)
        which = which[np.argsort(core[which], kind="stable")]
        some: list[int] = []
        size = 0
        for i in which.tolist():
            # segments with more than one minimiser (core 0) come first and go with all they may meet
            if size >= INDEX_BYTES and core[i] != core[some[-1]] and not (segments.off[some] < 0).any():
                yield from _indexed(segments.take(np.array(some)), window)
                some, size = [], 0
            some.append(i)
            size += len(segments.text[i])
        if len(some):
            yield from _indexed(segments.take(np.array(some)), window)
    return settle


def _indexed(segments: Segments, window: int) -> Iterator[pa.RecordBatch]:
    data = np.frombuffer(bytes([END]).join(segments.text) + bytes([END]), np.uint8)
    sizes = segments.sizes() + 1
    begin = np.cumsum(sizes) - sizes
    depth = 8
    while depth < window:
        depth *= 2
    suffixes = sorted_suffixes(data, depth)
    shares = long_borders(data, suffixes, window)
    of = np.repeat(np.arange(len(sizes)), sizes)
    inside = np.arange(len(data)) - begin[of]
    group = np.concatenate(([0], np.cumsum(~shares)))
    real = (inside < segments.windows[of])[suffixes]
    suffixes, group = suffixes[real], group[real]
    own = of[suffixes]
    place = segments.start[own] + inside[suffixes]
    order = np.lexsort((place, segments.tie[own], segments.doc[own], group))
    group, own, place = group[order], own[order], place[order]
    if not len(group):
        return
    again = np.zeros(len(group), bool)
    again[1:] = group[1:] == group[:-1]
    leader = np.maximum.accumulate(np.where(again, 0, np.arange(len(group))))
    again &= ~((segments.doc[own] == segments.doc[own[leader]]) & (segments.tie[own] == segments.tie[own[leader]]) & (place == place[leader]))
    if again.any():
        a, low = own[again], place[again]
        yield ranges(segments.doc[a], segments.tie[a], low, low + window)


OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _left(batch: pa.RecordBatch) -> Iterator[tuple[int, int, Texts, np.ndarray, list[bytes]]]:
    """Blocks of rows with ``text`` and ``spans``: first row, end row, texts, which bytes
    are marked, and what is left of each text."""
    for at, end, texts in blocks(batch):
        gone = marked(batch.column("spans").slice(at, end - at), texts.bounds)
        data = texts.data[~gone].tobytes()
        edges = np.concatenate(([0], np.cumsum(np.diff(texts.bounds) - texts.per_text(gone)))).tolist()
        yield at, end, texts, gone, [data[a:b] for a, b in zip(edges, edges[1:])]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in with_texts(whole)):
        for at, end, texts, gone, parts in _left(batch):
            before = np.concatenate(([False], gone[:-1]))[:len(gone)]
            before[texts.bounds[:-1][np.diff(texts.bounds) > 0]] = False
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(at, end - at), pa.array(np.diff(texts.bounds)), pa.array(texts.per_text(gone)),
                 pa.array(texts.per_text(gone & ~before)), pa.array([hashlib.sha256(p).hexdigest() for p in parts], pa.string())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    texts, found = repeats(docs, window, cutter(window, GRAM), settler(window, GRAM), bounds=bounds_of(window))
    out = with_ranges(texts, found).select("doc_id", "packed", "spans").mapInArrow(_digests, OUT)
    return out.withColumn("doc_id", F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")))


def shorten(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs``, all columns, with what is left of each text, ``n_chars`` (if it is there)
    counted anew. Every row stays, if need be with an empty text."""
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("rec")
    texts, found = repeats(docs, window, cutter(window, GRAM), settler(window, GRAM), others, bounds=bounds_of(window))
    schema = f"rec {texts.schema['rec'].dataType.simpleString()}, kept_text string"
    left = with_ranges(texts, found).select("rec", "packed", "spans").mapInArrow(_shorten, schema)
    columns = [F.col("kept_text").alias(c) if c == "text" else
               F.length("kept_text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"rec.`{c}`")
               for c in docs.columns]
    return left.select(*columns)


def _shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in with_texts(whole)):
        for at, end, _, _, parts in _left(batch):
            yield pa.RecordBatch.from_arrays([batch.column("rec").slice(at, end - at),
                                              pa.array([p.decode("utf-8", "ignore") for p in parts], pa.string())], ["rec", "kept_text"])
