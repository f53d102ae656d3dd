import hashlib
import random
from collections import Counter
from itertools import groupby

import numpy as np
import pyarrow as pa
import pytest

from henhouse.llm import segments, substring_dedup, suffix_dedup
from henhouse.llm.common import NULL_ID, keyed_texts, written
from henhouse.llm.words import blocks
from tests.llm import brute
from tests.llm.conftest import DOC_SCHEMA, awkward_texts


def _local(rows, window, cut, settle, buckets=7, block=4000):
    """The ranges that cutting, packing and settling find, without Spark."""
    ids, ties = np.array([k[0] for k, _ in rows]), np.array([k[1] for k, _ in rows])
    batch = pa.RecordBatch.from_arrays([pa.array([t or "" for _, t in rows])], ["text"])
    held, found = {}, []
    for at, end, texts in blocks(batch, size=block):
        start, n, off, least, no, text = cut(texts)
        if len(start):
            own, known, stays = segments.compacted(segments.Segments(ids[at:end][no], ties[at:end][no], start, n, off, text), window)
            found.append(segments._unpacked_ranges(segments._packed_ranges(known)) if known.num_rows else known)
            bucket = segments.mix(least[stays]) % np.uint64(buckets)
            for b in range(buckets):
                part = own.take(np.flatnonzero(bucket == b))
                held.setdefault(b, []).append(segments.Segments.unpacked(part.packed()))
    for parts in held.values():
        found += segments._settled(parts, window, settle)
    gone = {}
    for f in found:
        for d, t, low, high in zip(*[c.to_pylist() for c in f.columns]):
            gone.setdefault((d, t), set()).update(range(low, high))
    return gone


def _rows(seed):
    rows = [((d if d is not None else NULL_ID, hash(t or "") % 1000), t) for d, t, *_ in awkward_texts(seed)]
    rng = random.Random(seed)
    return rows + [((9000 + i, 0), "ab " * rng.randrange(1, 300) + "xyz" * rng.randrange(60) + "q" * i) for i in range(30)]


CASES = {
    "words": (20, lambda t: brute.WORD.findall(t or ""), substring_dedup.cutter(20, 5), substring_dedup.settler(20)),
    "bytes": (100, lambda t: (t or "").encode(), suffix_dedup.cutter(100, 16), suffix_dedup.settler(100, 16)),
}


@pytest.mark.parametrize("kind", CASES)
@pytest.mark.parametrize("seed", range(3))
def test_places_equal_brute_force(kind, seed, monkeypatch):
    window, units, cut, settle = CASES[kind]
    rows = _rows(seed)
    want = brute.repeats(rows, units, window)
    for block in (1, 4000, 1 << 22):
        monkeypatch.setattr(suffix_dedup, "INDEX_BYTES", block)
        got = _local(rows, window, cut, settle, block=block)
        for k, (_, gone) in want.items():
            assert {i for i, g in enumerate(gone) if g} == got.get(k, set()), k


def test_windows_that_clash_under_a_hash(monkeypatch):
    window, units, cut, settle = CASES["words"]
    real = substring_dedup.windows
    monkeypatch.setattr(substring_dedup, "windows", lambda *a: (lambda at, h: (at, h % np.uint64(50)))(*real(*a)))
    rows = _rows(1)
    got = _local(rows, window, cut, settle)
    for k, (_, gone) in brute.repeats(rows, units, window).items():
        assert {i for i, g in enumerate(gone) if g} == got.get(k, set())


def test_borders_of_suffixes():
    rng = random.Random(1)
    for n in (1, 2, 50, 3000):
        text = (bytes(rng.choice(b"ab") for _ in range(n)) + b"\xff") * 2
        data = np.frombuffer(text, np.uint8)
        order = suffix_dedup.sorted_suffixes(data, 16)
        heads = [text[i:i + 16] for i in order]
        assert heads == sorted(heads)
        shares = suffix_dedup.long_borders(data, order, 10)
        for i in range(1, len(text)):
            a, b = text[order[i - 1]:order[i - 1] + 10], text[order[i]:order[i] + 10]
            if b"\xff" not in a and b"\xff" not in b:
                assert shares[i - 1] == (a == b)


def _keyed(docs):
    """Rows with the operators' own key, a missing doc_id before all others."""
    return [((r.doc_id if r.doc_id is not None else NULL_ID, r.tie), r.text) for r in keyed_texts(docs).collect()]


def _id(key):
    return None if key[0] == NULL_ID else key[0]


def test_words_of_a_table(spark, awkward_docs, no_docs):
    rows = _keyed(awkward_docs)
    want = brute.repeats(rows, CASES["words"][1], 20)
    expected = Counter()
    for k, _ in rows:
        words, gone = want[k]
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        expected[_id(k), len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept] += 1
    got = Counter(tuple(r) for r in substring_dedup.remove_repeats(awkward_docs, with_text=True).collect())
    assert got == expected
    assert substring_dedup.remove_repeats(no_docs).count() == 0


def test_bytes_of_a_table(spark, awkward_docs, no_docs):
    rows = _keyed(awkward_docs)
    want = brute.repeats(rows, CASES["bytes"][1], 100)
    expected, texts = Counter(), Counter()
    for k, _ in rows:
        data, gone = want[k]
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(1 for g, _ in groupby(gone) if g)
        expected[_id(k), len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()] += 1
        texts[_id(k), kept.decode("utf-8", "ignore")] += 1
    got = Counter(tuple(r) for r in suffix_dedup.remove_repeats(awkward_docs).collect())
    assert got == expected
    left = suffix_dedup.shorten(awkward_docs)
    assert left.columns == awkward_docs.columns
    found = left.collect()
    assert Counter((r.doc_id, r.text) for r in found) == texts
    assert all(r.n_chars == len(r.text) for r in found)
    assert suffix_dedup.remove_repeats(no_docs).count() == 0 and suffix_dedup.shorten(no_docs).count() == 0


def test_unique_ids_and_a_large_group_of_copies(spark):
    rows = [(i, t, "en", "s", 1) for i, (_, t, *_) in enumerate(awkward_texts(9))] + [(5000 + i, awkward_texts(9)[0][1], "en", "s", 1) for i in range(200)]
    docs = written(spark.createDataFrame(rows, DOC_SCHEMA).repartition(5), "unique")
    for kind, run, count in (("words", substring_dedup.remove_repeats, "n_removed"), ("bytes", suffix_dedup.remove_repeats, "n_removed")):
        want = brute.repeats([(d, t) for d, t, *_ in rows], CASES[kind][1], CASES[kind][0])
        got = {r.doc_id: r[count] for r in run(docs).collect()}
        assert got == {d: sum(g) for d, (_, g) in want.items()}


@pytest.mark.parametrize("kind", CASES)
def test_a_hot_minimiser_is_dealt_out_by_windows(spark, kind):
    """A phrase in all documents, between different neighbours: no bucket is settled with
    more distinct bytes than its limit, and the places are those of brute force."""
    window, units, cut, settle = CASES[kind]
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8)))
    phrase = " ".join(word() for _ in range(24))
    texts = [" ".join([*(word() for _ in range(15)), phrase, *(word() for _ in range(15))]) for _ in range(120)]
    docs = written(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "hot")
    limit = 4000

    def within_limit(held):
        if sum(map(len, held.text)) > limit:
            raise ValueError("a bucket over the limit")
        yield from settle(held)

    module = {"words": substring_dedup, "bytes": suffix_dedup}[kind]
    _, found = segments.repeats(docs, window, cut, within_limit, bounds=module.bounds_of(window), hot_bytes=limit)
    got = {}
    for r in found.collect():
        got.setdefault((r.doc_id, r.tie), set()).update(range(r.low, r.high))
    want = brute.repeats([((i, 0), t) for i, t in enumerate(texts)], units, window)
    assert got == {k: places for k, (_, gone) in want.items() if (places := {i for i, g in enumerate(gone) if g})}


def test_joined_ranges():
    doc = np.array([1, 1, 1, 1, 2, 2, -5]); tie = np.zeros(7, np.int64)
    low, high = np.array([0, 5, 20, 21, 0, 90, 3]), np.array([6, 10, 30, 22, 4, 95, 9])
    got = sorted(zip(*[c.to_pylist() for c in segments.ranges(doc, tie, low, high).columns]))
    assert got == [(-5, 0, 3, 9), (1, 0, 0, 10), (1, 0, 20, 30), (2, 0, 0, 4), (2, 0, 90, 95)]
