"""Substring de-duplication over words by super-k-mers.

A window is ``WINDOW`` consecutive words of one document. The minimiser of a window is the
least hash among its runs of ``GRAM`` words; consecutive windows with the same minimiser
travel as one string, their words joined by spaces, to the minimiser's bucket
(``segments``). There all windows of the distinct strings are sorted by hash, equal hashes
are confirmed on the words themselves, and of equal windows all but the one that starts
first (smaller doc_id, then place) mark the words they cover. The marks of a document are
joined with its text once.

Defined results: a null text has no words; documents shorter than a window keep every
word; rows that share a doc_id but not the text are ordered by a hash of the text; rows
equal in both are one document seen twice: they get the same result and are no repeats
of each other; a null doc_id comes before all others; an empty table gives an empty
result; other columns are ignored.
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
from henhouse.llm.words import Texts, blocks, windows

WINDOW, GRAM = 20, 3


def joined_words(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts, each followed by one space, and where each begins."""
    lengths = texts.ends - texts.starts
    begins = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths + 1, out=begins[1:])
    out = np.full(begins[-1], 32, np.uint8)
    place = np.ones(begins[-1], bool)
    place[begins[1:] - 1] = False
    out[place] = texts.data[texts.solid]
    return out, begins


def cutter(window: int, gram: int):
    def cut(texts: Texts):
        words = texts.word_hashes()
        grams = np.full(len(words), np.iinfo(np.uint64).max, np.uint64)
        at, hashes = windows(texts.first, words, gram)
        grams[at] = hashes
        of = texts.text_of_word()
        room = texts.first[of + 1] - np.arange(len(words))
        valid = np.flatnonzero(room >= window)
        if not len(valid):
            none = np.zeros(0, np.int64)
            return none, none, none, none.astype(np.uint64), none, []
        least = sliding_min(grams, window - gram + 1)[valid]
        first, count = runs(valid, least)
        begin, end = valid[first], valid[first] + count - 1 + window
        data, begins = joined_words(texts)
        data = data.tobytes()
        text = [data[a:b] for a, b in zip(begins[begin].tolist(), begins[end].tolist())]
        no = of[begin]
        return begin - texts.first[no], count, np.zeros(len(begin), np.int64), least[first], no, text
    return cut


def bounds_of(window: int):
    def bounds(text: bytes) -> tuple[np.ndarray, np.ndarray]:
        ends = np.flatnonzero(np.frombuffer(text, np.uint8) == 32) + 1  # of the words, each with its space
        return np.concatenate(([0], ends))[:len(ends) - window + 1], ends[window - 1:]
    return bounds


def _same_spans(data: bytes, low: np.ndarray, high: np.ndarray, other_low: np.ndarray, other_high: np.ndarray) -> np.ndarray:
    return np.fromiter((data[a:b] == data[c:d] for a, b, c, d in zip(low.tolist(), high.tolist(), other_low.tolist(), other_high.tolist())),
                       bool, len(low))


def _windows_of(segments: Segments, window: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Hash, segment, place, and first and end byte (among the joined segments) of every
    window, a slice of the segments at a time."""
    sizes = segments.sizes()
    before = 0
    for a, b in slices(sizes):
        bounds = np.concatenate(([0], np.cumsum(sizes[a:b])))
        texts = Texts(np.frombuffer(b"".join(segments.text[a:b]), np.uint8), bounds)
        starts, hashes = windows(texts.first, texts.word_hashes(), window)
        own = texts.text_of_word()[starts]
        yield (hashes, own + a, segments.start[a:b][own] + starts - texts.first[own],
               texts.starts[starts] + before, texts.ends[starts + window - 1] + before)
        before += int(bounds[-1])


def settler(window: int):
    def settle(segments: Segments) -> Iterator[pa.RecordBatch]:
        """The ranges of the windows that are not the first of their kind in the bucket."""
        if not segments.text:
            return
        hashes, segment, place, low, high = (np.concatenate(c) for c in zip(*_windows_of(segments, window)))
        order = np.lexsort((place, segments.tie[segment], segments.doc[segment], hashes))
        hashes = hashes[order]
        again = np.zeros(len(order), bool)
        again[1:] = hashes[1:] == hashes[:-1]
        if not again.any():
            return
        leader = np.maximum.accumulate(np.where(again, 0, np.arange(len(order))))
        again = np.flatnonzero(again)
        mine, its = order[again], order[leader[again]]
        data = b"".join(segments.text)
        same = _same_spans(data, low[mine], high[mine], low[its], high[its])
        if not same.all():  # two contents under one hash: tell them apart by the words
            groups: dict[bytes, int] = {}
            odd = np.isin(leader, np.unique(leader[again[~same]]))
            for i in np.flatnonzero(odd).tolist():
                w = order[i]
                groups.setdefault(data[low[w]:high[w]], w)
            its = np.array([groups.get(data[low[w]:high[w]], l) if odd[i] else l for i, w, l in zip(again.tolist(), mine.tolist(), its.tolist())])
            differ = mine != its
            mine, its = mine[differ], its[differ]
        a, b = segment[mine], segment[its]
        real = ~((segments.doc[a] == segments.doc[b]) & (segments.tie[a] == segments.tie[b]) & (place[mine] == place[its]))
        mine, a = mine[real], a[real]
        yield ranges(segments.doc[a], segments.tie[a], place[mine], place[mine] + window)
    return settle


OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _apply(with_text: bool):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in with_texts(whole)):
            for at, end, texts in blocks(batch):
                ids = batch.column("doc_id").slice(at, end - at)
                spans = batch.column("spans").slice(at, end - at)
                gone = marked(spans, texts.first)
                data, begins = joined_words(texts)
                stays = np.repeat(~gone, np.diff(begins))
                data = data[stays].tobytes()
                kept = np.zeros(len(begins), np.int64)
                np.cumsum(np.where(gone, 0, np.diff(begins)), out=kept[1:])
                edges = kept[texts.first].tolist()
                parts = [data[a:max(a, b - 1)] for a, b in zip(edges, edges[1:])]
                removed = np.diff(np.concatenate(([0], np.cumsum(gone)))[texts.first])
                cols = [ids, pa.array(np.diff(texts.first)), pa.array(removed),
                        pa.array([hashlib.sha256(p).hexdigest() for p in parts])]
                if with_text:
                    cols.append(pa.array([p.decode() for p in parts]))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"][:len(cols)])
    return apply


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 (and ``kept_text``,
    the kept words joined by one space)."""
    texts, found = repeats(docs, window, cutter(window, gram), settler(window), bounds=bounds_of(window))
    out = (with_ranges(texts, found).select("doc_id", "packed", "spans")
           .mapInArrow(_apply(with_text), OUT + (", kept_text string" if with_text else "")))
    return out.withColumn("doc_id", F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")))
