import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from henhouse.llm import lsh_forest
from henhouse.llm.common import written
from tests.llm import brute
from tests.llm.conftest import DOC_SCHEMA


def _copies(seed, n, words=150, edits=9, hub=False):
    """Copies of one text with some words changed; with ``hub`` each from the first."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(900)}" for _ in range(words)]
    rows = [(seed * 100_000, " ".join(base), "en", "s", 1)]
    for i in range(1, n):
        if not hub and i % 7 == 0:
            base = list(base)
            base[rng.randrange(words)] = f"d{i}"
        copy = list(base)
        for _ in range(edits if hub else rng.randrange(edits)):
            copy[rng.randrange(words)] = f"e{rng.randrange(9999)}"
        rows.append((seed * 100_000 + i, " ".join(copy), "en", "s", 1))
    return rows


def _want(rows):
    return Counter((d, n, c, d is not None and d == c) for d, n, c in brute.ngram_components([(d, t) for d, t, *_ in rows], n=2))


def _got(docs, **options):
    return Counter(tuple(r) for r in lsh_forest.near_components(docs, **options).collect())


@pytest.mark.parametrize("region", [lsh_forest.REGION, 8])
def test_equals_brute_force(spark, awkward, region):
    """Also where regions are split down to full depth and dealt into parts."""
    rows = awkward + _copies(3, 90)
    docs = spark.createDataFrame(rows, DOC_SCHEMA).withColumn("sig", F.lit(1)).withColumn("cid", F.lit("x")).repartition(3)
    assert _got(written(docs, "forest"), region=region) == _want(rows)


def test_copies_that_link_only_through_one_text(spark):
    """Each copy is near the original but not near the other copies."""
    rows = _copies(4, 120, words=160, edits=8, hub=True)
    want = _want(rows)
    assert max(Counter(c for _, _, c, _ in want).values()) > 60
    assert _got(written(spark.createDataFrame(rows, DOC_SCHEMA), "forest")) == want


def test_similar_texts_that_do_not_link(spark):
    """Many candidates that the full sets refuse."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(w if rng.random() > 0.06 else f"x{i}-{k}" for k, w in enumerate(base)), "en", "s", 1) for i in range(60)]
    assert _got(written(spark.createDataFrame(rows, DOC_SCHEMA), "forest")) == _want(rows)


@pytest.mark.parametrize("block", [1000, 25])
def test_refused_pairs_are_not_written(spark, monkeypatch, block):
    """Of similar texts nearly every pair is a candidate that the full sets refuse; no table
    holds them, whether the family is one block or several."""
    rng = random.Random(12)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(w if rng.random() > 0.04 else f"x{i}-{k}" for k, w in enumerate(base)), "en", "s", 1) for i in range(80)]
    counts = {}

    def counted(df, name):
        out = written(df, name)
        counts[name] = max(counts.get(name, 0), out.count())
        return out

    monkeypatch.setattr(lsh_forest, "written", counted)
    docs = written(spark.createDataFrame(rows, DOC_SCHEMA), "forest")
    assert _got(docs, **({} if block == 1000 else {"block": block})) == _want(rows)
    assert max(counts.values()) <= lsh_forest.TREES * len(rows), counts


def test_empty_table(no_docs):
    assert _got(no_docs) == Counter()


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(3)
    errors = []
    for _ in range(60):
        common = rng.integers(0, 1 << 63, 160).astype(np.uint64)
        a = np.append(common, rng.integers(0, 1 << 63, 20).astype(np.uint64))
        b = np.append(common, rng.integers(0, 1 << 63, 20).astype(np.uint64))
        sigs = lsh_forest.minhash(np.concatenate((a, b)), np.array([0, 180, 180, 360]))
        assert len(sigs) == 2  # an empty set has none
        errors.append((sigs[0] == sigs[1]).mean() - 0.8)
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.03


def test_candidates_are_spanning_forests():
    sigs = np.zeros((5, 288), np.uint8)
    sigs[3:] = 7
    size = np.full(5, 100)
    assert lsh_forest.candidates(sigs, size, [0, 1, 2, 3, 4], 80, set(), 1) == [(0, 1), (0, 2), (3, 4)]
    assert lsh_forest.candidates(sigs, size, [0, 1, 2, 3, 4], 80, {(0, 1)}, 1) == [(0, 2), (1, 2), (3, 4)]
    assert lsh_forest.candidates(sigs, size, [0, 0, 2, 3, 3], 80, set(), None) == [(0, 2), (1, 2)]


def test_every_pair_of_a_region_too_large_at_full_depth_is_compared(spark):
    """Forty unrelated classes share all values of a tree; parts of them leave no pair out."""
    rest = spark.createDataFrame([(i, i, 0, b"ab" * lsh_forest.DEPTH) for i in range(40)], "cid long, label long, tree int, values binary")
    members, wide = lsh_forest.regions(rest, size=8, again=True)
    together = {}
    for region, part, cid in members.collect():
        together.setdefault((region, part), set()).add(cid)
    met = {(a, b) for classes in together.values() for a in classes for b in classes if a < b}
    assert wide and len(met) == 40 * 39 // 2
