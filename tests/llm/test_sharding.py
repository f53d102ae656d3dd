import zlib
from collections import Counter, defaultdict

import pytest

from henhouse.llm import sharding
from henhouse.llm.common import written
from henhouse.session import scratch_path
from tests.llm.conftest import DOC_SCHEMA


def _check(df, rows, shards):
    got = df.collect()
    want = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    for found in by.values():
        assert sorted(r.slot for r in found) == list(range(len(found)))
    assert set(by) <= set(range(shards))
    sizes = [sum(r["size"] for r in by[s]) for s in range(shards)]
    even, most = sum(sizes) / shards, max((r["size"] for r in got), default=0)
    assert all(abs(s - even) <= most + 0.01 * even for s in sizes)
    return got


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_awkward_rows(spark, awkward, awkward_docs, shards):
    _check(sharding.shards_by_bytes(awkward_docs, shards), [(d, t) for d, t, *_ in awkward], shards)


def test_a_hot_text_and_a_hot_row_are_cut(spark):
    rows = [(i, "same text", "en", "s", 1) for i in range(300)] + [(7, "the very same row", "en", "s", 1)] * 300
    rows += [(1000 + i, f"text {i}", "en", "s", 1) for i in range(300)]
    docs = written(spark.createDataFrame(rows, DOC_SCHEMA).repartition(3), "hot")
    got = _check(sharding.shards_by_bytes(docs), [(d, t) for d, t, *_ in rows], 8)
    assert len({r.shard for r in got if r.doc_id == 7}) > 1


def test_small_groups_stay_together_and_files_hold_all(spark, no_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = _check(sharding.shards_by_bytes(docs), [(r.doc_id, r.text) for r in docs.collect()], 8)
    where = defaultdict(set)
    for r in got:
        where[r.text_crc32].add(r.shard)
    assert max(map(len, where.values())) == 1
    path = scratch_path(spark, "shards")
    sharding.write_shards(docs, path)
    back = spark.read.parquet(path)
    assert {r.doc_id: r.shard for r in back.select("doc_id", "shard").collect()} == {r.doc_id: r.shard for r in got}
    assert back.drop("shard").exceptAll(docs).count() == 0 and back.count() == docs.count()
    assert sharding.shards_by_bytes(no_docs).count() == 0
    with pytest.raises(ValueError):
        sharding.write_shards(back, path + "-2")
