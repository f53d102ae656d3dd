import random
from collections import Counter

import numpy as np
import pytest

from henhouse.llm import ngram_join
from henhouse.llm.common import written
from tests.llm import brute
from tests.llm.conftest import DOC_SCHEMA


def _near_copies(seed=5, n=110):
    """A family whose members are linked in chains, some only to a few others."""
    rng = random.Random(seed)
    words = [f"w{rng.randrange(500)}" for _ in range(120)]
    rows = []
    for i in range(n):
        if i % 9 == 0:
            words = list(words)
            words[rng.randrange(len(words))] = f"d{i}"
        copy = list(words)
        for _ in range(rng.randrange(7)):
            copy[rng.randrange(len(copy))] = f"e{rng.randrange(999)}"
        rows.append((5000 + i, " ".join(copy), "en", "s", 1))
    return rows


@pytest.mark.parametrize("block", [1000, 12])
def test_equals_brute_force(spark, awkward, block):
    rows = awkward + _near_copies()
    docs = written(spark.createDataFrame(rows, DOC_SCHEMA).repartition(3), "near")
    got = Counter(tuple(r) for r in ngram_join.component_of_each(docs, block=block).collect())
    assert got == Counter(brute.ngram_components([(d, t) for d, t, *_ in rows]))


def test_unique_ids_and_dropping(spark):
    rows = [(i, t, *r) for i, (_, t, *r) in enumerate(_near_copies(6, 60))]
    docs = written(spark.createDataFrame(rows, DOC_SCHEMA).repartition(3), "near")
    want = brute.ngram_components([(d, t) for d, t, *_ in rows])
    assert Counter(tuple(r) for r in ngram_join.component_of_each(docs, block=10).collect()) == Counter(want)
    left = ngram_join.keep_one_each(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted({c for *_, c in want})


def test_dropping_on_awkward_rows(spark, awkward, awkward_docs, no_docs):
    left = ngram_join.keep_one_each(awkward_docs)
    assert left.columns == awkward_docs.columns
    want = brute.ngram_components([(d, t) for d, t, *_ in awkward])
    alone = {(d, t) for d, t, *_ in awkward if not brute.shingles(t)}
    linked = {c for (d, t, *_), (_, n, c) in zip(awkward, want) if n}
    # each component leaves one row; the family of a missing id counts by its named members
    assert left.count() in (len(alone) + len(linked), len(alone) + len(linked) + 1)
    assert ngram_join.component_of_each(no_docs).count() == 0
    assert ngram_join.keep_one_each(no_docs).count() == 0


def test_search_finds_exactly_the_linked_sets():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 60, 80).astype(np.uint64)
    sets = []
    for _ in range(60):
        own = base[rng.random(80) < rng.uniform(0.7, 1.0)]
        sets.append(np.unique(np.append(own, rng.integers(0, 1 << 60, rng.integers(0, 12)).astype(np.uint64))))
    index = ngram_join.Index(80)
    for i, s in enumerate(sets):
        want = {j for j in range(i) if 100 * len(np.intersect1d(s, sets[j])) >= 80 * len(np.union1d(s, sets[j]))}
        assert set(index.search(s, lambda j: False)) == want
        index.add(s)


def test_packed_arrays_come_back():
    a, b = np.array([1, 2**40, 7], np.uint64), np.array([9, 8, 65535], np.uint16)
    x, y = ngram_join._unpacked(ngram_join._packed(a, b), "<u8", "<u2")
    assert (x == a).all() and (y == b).all()
