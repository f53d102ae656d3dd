"""Packing token ids into fixed-length sequences by shortest-pack-first over the length
histogram.

Each document (its ids and an end id) is cut into pieces of at most ``size`` ids: whole
pieces, then the rest. Only the histogram of piece lengths (at most ``size`` numbers)
reaches the driver. There lengths are placed longest first; a length's pieces go to the
kind of pack that is emptiest so far, and the counts of packing patterns are updated
rather than any single pack, so the work depends on the number of lengths and patterns
and not on the number of documents. Pieces that fit no open pack open one that further
pieces of their length fill up. The patterns come back as a small table: pieces of
length L with ranks a..b fill one place of one pattern. Ranks come from one range
exchange of the piece records (``ranks.ranked``), which splits a length that a third of
all pieces share over many tasks.

Defined results: a null or empty text is one piece holding the end id alone; rows equal
in doc_id and text are separate documents with equal pieces; a null doc_id is kept; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from henhouse.llm.common import keyed_texts, written
from henhouse.llm.ranks import ranked
from henhouse.llm.tokens import byte_bpe_path, encode, let_go, ship

PIECES = "doc_id long, tie long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, vocabulary: str, end_id: int, size: int, with_ids: bool = False, remembered: int | None = None) -> DataFrame:
    """The pieces of every document, in any order; ``with_ids`` adds the ids themselves."""
    name = ship(docs.sparkSession, vocabulary)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(7)]
            texts = batch.column("text").to_pylist()
            for doc, tie, ids in zip(batch.column("doc_id").to_pylist(), batch.column("tie").to_pylist(),
                                     encode(name, texts, remembered)):
                ids = np.append(ids, ids.dtype.type(end_id))
                for at in range(0, len(ids), size):
                    part = ids[at:at + size].astype("<u4")
                    row = (doc, tie, at, len(part), zlib.crc32(part.tobytes()), len(ids), part)
                    for col, value in zip(cols, row):
                        col.append(value)
            names = ["doc_id", "tie", "start", "length", "ids_crc32", "doc_tokens"]
            arrays = [pa.array(c, pa.int64()) for c in cols[:6]]
            if with_ids:
                names.append("ids")
                arrays.append(pa.array([p.astype(np.int32) for p in cols[6]], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, names)

    return keyed_texts(docs).mapInArrow(cut, PIECES + (", ids array<int>" if with_ids else ""))


def patterns(histogram: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Packing patterns (lengths in order of placement) and how many packs follow each."""
    packs: list[tuple[int, int, tuple[int, ...], int]] = []  # heap: most free space first
    order = 0
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if packs and -packs[0][0] >= length:
                free, _, lengths, count = heapq.heappop(packs)
                if count > left:
                    heapq.heappush(packs, (free, order, lengths, count - left))
                    order += 1
            else:  # none fits: the pack opened next is the emptiest until it is full of this length
                per = size // length
                for times, opened in ((per, left // per), (left % per, 1)):
                    if times and opened:
                        heapq.heappush(packs, (times * length - size, order, (length,) * times, opened))
                        order += 1
                break
            used = min(count, left)
            left -= used
            grown = (free + length, order, (*lengths, length), used)
            order += 1
            heapq.heappush(packs, grown)
    return [(lengths, count) for _, _, lengths, count in sorted(packs, key=lambda p: p[1])]


def places(found: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, sequence of the first rank, offset in the sequence)."""
    out, taken, sequence = [], {}, 0
    for lengths, count in found:
        offset = 0
        for length in lengths:
            low = taken.get(length, 0)
            out.append((length, low, low + count, sequence, offset))
            taken[length] = low + count
            offset += length
        sequence += count
    return out


def placer(found: list[tuple[int, int, int, int, int]], size: int) -> Callable:
    """Pieces with their sequence and offset, looked up by length and rank: a length has as
    many places as patterns hold it, too many to join each piece with all of them. All texts
    are cut by then, so the workers let go of their encoders."""
    table = np.array(sorted(found), np.int64).reshape(-1, 5)
    length, low, high, sequence, offset = table.T
    first = np.zeros(size + 1, np.int64)  # pieces of lesser lengths
    ends = np.cumsum(high - low)
    starts = ends - (high - low)
    at = np.flatnonzero(low == 0)
    first[length[at]] = starts[at]
    shift = sequence - low

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            rank = np.asarray(batch.column("rank"))
            at = np.searchsorted(starts, first[np.asarray(batch.column("length"))] + rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(shift[at] + rank), pa.array(offset[at])],
                                             [*batch.schema.names[:-1], "sequence_id", "offset"])

    return place


def pack(docs: DataFrame, vocabulary: str | None = None, end_id: int = 1, size: int = 2048,
         with_ids: bool = False, remembered: int | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset
    (and ids). ``remembered`` bounds the bytes of parts a worker keeps. Sequences are numbered from 0 and padded to ``size`` by whoever writes them."""
    spark = docs.sparkSession
    cut = written(pieces(docs, vocabulary or byte_bpe_path(), end_id, size, with_ids, remembered), "pieces")
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    lines = ranked(cut.drop("ids"), "length", ["doc_id", "tie", "start"], "piece-ranks")
    placed = lines.select("doc_id", "tie", "start", "length", "ids_crc32", "doc_tokens", "rank").mapInArrow(
        placer(places(patterns(counts, size)), size), PIECES + ", sequence_id long, offset long")
    if with_ids:
        same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("doc_id", "tie", "start")]
        ids = cut.select("doc_id", "tie", "start", "ids").dropDuplicates(["doc_id", "tie", "start"])
        placed = placed.alias("a").join(ids.alias("b"), same).select("a.*", "b.ids")
    return placed.drop("tie")
