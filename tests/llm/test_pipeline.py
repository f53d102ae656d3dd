import random
from collections import Counter
from pathlib import Path

import pyarrow as pa

import corpus_pipeline
from henhouse.llm import exact_dedup, ngram_join, packing, quality, suffix_dedup, tokens
from henhouse.llm.common import written
from henhouse.llm.ranks import ranked
from tests.llm import brute
from tests.llm.test_tokens import _check_packs

SF = "/root/testdata/sf0.001"


def test_stages_against_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_copies", "near_copies", "repeated_passages", "packed"]
    for name, stage in corpus_pipeline.STAGES:
        rows = {r.doc_id: r.text for r in docs.collect()}
        out = written(stage(spark, docs, SF), f"stage-{name}")
        got = out.collect()
        if name != "packed":
            assert out.columns == docs.columns
            assert len({r.doc_id for r in got}) == len(got)
            found = {r.doc_id: r.text for r in got}
        if name == "quality_rules":
            kept = {r.doc_id for r in quality.judge(docs.select("doc_id", "text")).filter("kept").collect()}
            assert found == {d: rows[d] for d in kept} and 0.7 * len(rows) < len(kept) < len(rows)
        elif name == "exact_copies":
            last = {}
            for d in sorted(rows):
                last[rows[d].translate(brute.LOWER)] = d
            assert found == {d: rows[d] for d in last.values()}
        elif name == "near_copies":
            want = brute.ngram_components(list(rows.items()))
            assert found == {d: rows[d] for d, _, c in want if d == c}
        elif name == "repeated_passages":
            want = brute.repeats(list(rows.items()), lambda t: (t or "").encode(), 100)
            assert found == {d: bytes(b for b, g in zip(data, gone) if not g).decode("utf-8", "ignore")
                             for d, (data, gone) in want.items()}
        else:
            _check_packs(got, list(rows.items()), 2048, 1)
        docs = out


def test_run_equals_the_stages_in_turn(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), f"turn-{name}")
    key = lambda df: Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in df.collect())
    assert key(corpus_pipeline.run(spark, SF)) == key(docs)


def _peak_mb(run):
    import tracemalloc

    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_memory_of_a_worker_does_not_grow_with_its_batch():
    """The arrays over the texts of a batch are made a block at a time (6 MB of text here)."""
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(400)) for _ in range(2500)]
    table = pa.table({"chunk": [0] * len(texts), "doc_id": range(len(texts)), "text": texts})

    class Docs:
        schema = []

        def mapInArrow(self, count, schema):
            for _ in count(iter(table.to_batches())):
                pass

    quality.with_counts(Docs()), ngram_join._chunk_sets(table, 5)  # tables made once
    assert _peak_mb(lambda: quality.with_counts(Docs())) < 45
    assert _peak_mb(lambda: ngram_join._chunk_sets(table, 5)) < 45


def test_workers_let_go_of_encoders_once_texts_are_cut(monkeypatch):
    """A worker that held them would hold them through the stages of the next run."""
    monkeypatch.setattr(tokens, "_LOADED", {("file", False, None): object()})
    lines = pa.RecordBatch.from_pydict({"length": [4, 4], "rank": [0, 1]})
    got = list(packing.placer([(4, 0, 2, 0, 0)], 4)(iter([lines])))
    assert got[0].to_pydict() == {"length": [4, 4], "sequence_id": [0, 1], "offset": [0, 0]}
    assert not tokens._LOADED


def test_small_tables_need_no_python_workers_of_their_own(spark):
    """A list of rows goes through a second kind of Python workers, beside those of the stages."""
    docs = spark.createDataFrame(pa.table({"doc_id": [1, 2], "text": ["so it is and was " * 9, "x"]}))
    posteriors = quality.keep_good(docs)
    ranks = ranked(docs, "text", ["doc_id"], "test-ranks")
    for df in (posteriors, ranks):
        assert "ExistingRDD" not in df._jdf.queryExecution().toString()
    assert {(r.doc_id, r.rank) for r in ranks.collect()} == {(1, 0), (2, 0)}
    empty = ranked(docs.limit(0), "text", ["doc_id"], "test-ranks")
    assert set(empty.columns) == {"doc_id", "text", "rank"} and empty.count() == 0


def test_state_stores_close_with_their_task(spark):
    """The stores of all partitions open at once, and after the stream, would be memory that other stages need."""
    root = Path(spark._jvm.org.apache.spark.util.Utils.getLocalDir(spark._jsc.sc().conf()))
    stores = lambda: {p for p in root.parent.rglob("StateStoreId*")}
    before = stores()
    docs = spark.createDataFrame(pa.table({"doc_id": list(range(40)), "text": [f"text {i % 30}" for i in range(40)]}))
    got = {r.doc_id for r in exact_dedup.drop_copies(spark, docs).collect()}
    assert got == set(range(10, 40))
    assert stores() <= before


def test_texts_are_packed_and_read_in_different_tasks(spark):
    """Few ranges, too: a task that did both would need two Python workers."""
    long = "".join(chr(97 + i * i % 26) for i in range(300)) + " and more "
    docs = spark.createDataFrame(pa.table({"doc_id": [1, 2, 3], "text": [long, "x" + long, "short"]}))
    left = suffix_dedup.shorten(docs)
    assert "BroadcastHashJoin" not in left._jdf.queryExecution().executedPlan().toString()
    want = brute.repeats([(1, long), (2, "x" + long), (3, "short")], lambda t: t.encode(), 100)
    assert {r.doc_id: r.text for r in left.collect()} == {
        d: bytes(b for b, g in zip(data, gone) if not g).decode() for d, (data, gone) in want.items()}
