from collections import Counter, defaultdict

from pyspark.sql import functions as F

from henhouse.llm import exact_dedup
from henhouse.llm.common import written
from henhouse.session import scratch_path
from tests.llm.brute import LOWER


def _stored(df, files=3):
    path = scratch_path(df.sparkSession, "stored")
    df.repartition(files).write.parquet(path)
    return path


def _want(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[(t or "").translate(LOWER)].append(d)
    out = Counter()
    for d, t in rows:
        ids = groups[(t or "").translate(LOWER)]
        out[d, max((i for i in ids if i is not None), default=None), len(ids)] += 1
    return out


def _check(df, rows):
    got = df.select("doc_id", "keep_id", "group_size", "kept", "source_file", "source_row").collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size) for r in got) == _want(rows)
    kept = [r for r in got if r.kept]
    assert all(r.doc_id == r.keep_id for r in kept)
    assert len(kept) == len({(t or "").translate(LOWER) for _, t in rows})
    assert len({(r.source_file, r.source_row) for r in got}) == len(rows)


def test_awkward_rows_in_any_number_of_batches(spark, awkward, awkward_docs):
    rows = [(d, t) for d, t, *_ in awkward]
    path = _stored(awkward_docs)
    _check(exact_dedup.decide(spark, path), rows)
    _check(exact_dedup.decide(spark, path, max_files_per_trigger=1), rows)


def test_full_texts_decide_where_digests_clash(spark, awkward, awkward_docs):
    """A digest of four values: nearly every hit fails the comparison of the bytes."""
    weak = lambda text: F.pmod(F.length(text), F.lit(4)).cast("string").cast("binary")
    _check(exact_dedup.decide(spark, _stored(awkward_docs), digest=weak), [(d, t) for d, t, *_ in awkward])


def test_single_file_and_empty_table(spark, no_docs):
    one = _stored(spark.createDataFrame([(1, "A b"), (2, "a B"), (3, "á"), (4, "Á")], "doc_id long, text string"), 1)
    file = [f for f in spark.read.parquet(one).inputFiles()][0]
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.decide(spark, file).collect()}
    assert got == {1: (2, 2, False), 2: (2, 2, True), 3: (3, 1, True), 4: (4, 1, True)}
    assert exact_dedup.decide(spark, _stored(no_docs)).count() == 0


def test_drop_copies_of_more_than_a_table(spark, awkward_docs):
    """Rows that are filtered or made are written first; a stored table is read in place."""
    some = awkward_docs.filter("doc_id > 30 or doc_id is null")
    assert exact_dedup._stored_at(awkward_docs) and exact_dedup._stored_at(some) is None
    texts = [(r.text or "").translate(LOWER) for r in some.collect()]
    assert exact_dedup.drop_copies(spark, some).count() == len(set(texts)) < len(texts)


def test_drop_copies_keeps_columns(spark, awkward, awkward_docs):
    left = written(exact_dedup.drop_copies(spark, awkward_docs), "left")
    assert left.columns == awkward_docs.columns
    texts = [(t or "").translate(LOWER) for _, t, *_ in awkward]
    assert left.count() == len(set(texts))
