import hashlib
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from henhouse.llm import merkle
from henhouse.llm.common import written
from tests.llm.brute import LOWER
from tests.llm.conftest import DOC_SCHEMA


def H(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(doc, text):
    enc = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc[0], doc[3], doc[2], doc[4], text)]
    return H(enc)


def _levels(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([H(below[i:i + 8]) for i in range(0, len(below), 8)])
    return levels


def _path(levels, at):
    path = []
    for nodes in levels[:-1]:
        low = at // 8 * 8
        path.append((nodes[low:at], nodes[at + 1:low + 8]))
        at //= 8
    return path


def _brute(rows):
    """rows: (doc_id, text, lang, source, n_chars). One result row for each."""
    by = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, _leaf(r, r[1]))):
        by.setdefault(r[2], []).append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: _levels([_leaf(r, r[1]) for r in by[x]]) for x in langs}
    top = _levels([trees[x][-1][0] for x in langs])
    root = top[-1][0] if langs else None
    out = []
    for k, x in enumerate(langs):
        for i, r in enumerate(by[x]):
            path = _path(trees[x], i) + _path(top, k)
            text = r[1]
            if text is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                text = text.translate(LOWER)
            node = _leaf(r, text)
            for before, after in path:
                node = H(before + [node] + after)
            proof = H([s for p in path for part in p for s in part])
            out.append((r[0], trees[x][0][i], trees[x][-1][0], root, proof, node, node == root))
    return out


def _same(docs, rows):
    got = Counter(tuple(r) for r in merkle.manifest(docs).collect())
    assert got == Counter(_brute(rows))


def test_awkward_rows_of_several_languages(spark, awkward):
    rows = [(d, t, (None, "de", "en", "zz\u00e9", "\U0001f600")[i % 5], s, n) for i, (d, t, _, s, n) in enumerate(awkward)]
    rows.append((5, "only one", "lone", None, None))
    docs = written(spark.createDataFrame(rows, DOC_SCHEMA).withColumn("node", F.lit("x")).withColumn("tree", F.lit(1))
                   .withColumn("at", F.lit(1)).withColumn("size", F.lit(1)).repartition(3), "merkle-docs")
    _same(docs, rows)


@pytest.mark.parametrize("n", [1, 8, 9, 64, 513, 4200])
def test_tree_sizes(spark, n):
    """Lone leaves, full and ragged runs, one to three stored levels."""
    rows = [(i * 7, f"Text {i}" if i % 3 else f"text {i}", "en", "s", i) for i in range(n)]
    docs = spark.createDataFrame(rows, DOC_SCHEMA).repartition(3)
    _same(docs, rows)


def test_many_languages(spark):
    rows = [(i, f"T{i}", f"l{i % 600}", "s", 1) for i in range(1300)]
    _same(spark.createDataFrame(rows, DOC_SCHEMA), rows)


def test_tampering_is_found(spark):
    rows = [(i, "ABC" if i % 2 else "abc", "en", "s", 1) for i in range(200)]
    got = {r.doc_id: r.verified for r in merkle.manifest(spark.createDataFrame(rows, DOC_SCHEMA)).collect()}
    assert got == {i: not (i % 2 and zlib.crc32(str(i).encode()) % 3 == 0) for i in range(200)}


def test_empty_table(no_docs):
    assert merkle.manifest(no_docs).collect() == []
