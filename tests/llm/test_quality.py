import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from henhouse.llm import quality
from henhouse.llm.words import blocks
from tests.llm.conftest import awkward_texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    often = Counter(grams)
    cover = set()
    for i, g in enumerate(grams):
        if often[g] > 1:
            cover.update(range(i, i + 8))
    return {"n_words": len(words), "word_chars": sum(map(len, words)),
            "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")),
            "n_dup_lines": dup, "n_repeat_words": len(cover)}


def test_counts_match_brute_force_in_any_block_size():
    rows = awkward_texts()
    texts = [t or "" for _, t, *_ in rows]
    batch = pa.RecordBatch.from_arrays([pa.array(["skipped"] + texts)], ["text"]).slice(1)
    for size in (1, 300, 1 << 22):
        at = 0
        for low, high, block in blocks(batch, size=size):
            assert low == at
            got = quality.counts(block)
            for i in range(low, high):
                want = brute(texts[i])
                assert {k: int(got[k][i - low]) for k in want} == want, texts[i][:80]
            at = high
        assert at == len(texts)


def test_query_on_awkward_rows(spark, awkward, awkward_docs):
    got = quality.judge(awkward_docs.select("doc_id", "text")).toPandas()
    assert len(got) == len(awkward)
    want = Counter((d, *brute(t).values()) for d, t, *_ in awkward)
    have = Counter((None if r.doc_id != r.doc_id else int(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines,
                    r.n_repeat_words) for r in got.itertuples())
    assert have == want
    failed = (got.n_words < 20) | (100 * got.n_repeat_words > 30 * got.n_words)
    assert (got.base_failed == failed).all()
    assert not (got.kept & got.base_failed).any()


def test_empty_table(spark, no_docs):
    assert quality.judge(no_docs).count() == 0
    assert quality.keep_good(no_docs).columns == no_docs.columns


def test_keep_good_carries_all_columns(spark, awkward_docs):
    assert quality.keep_good(awkward_docs).columns == awkward_docs.columns
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("*", "1 as kept", "2 as n_words")
    rows = {tuple(r) for r in docs.collect()}
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    left = {tuple(r) for r in kept.collect()}
    assert left < rows and len(left) > 0.7 * len(rows)


def test_estimate_recovers_planted_accuracies():
    rng = np.random.default_rng(1)
    n, good = 40_000, 0.75
    truth = rng.random(n) < good
    right = [0.95, 0.9, 0.8, 0.7, 0.6]
    votes = np.array([np.where(rng.random(n) < 0.3, 2, np.where(rng.random(n) < a, truth, ~truth)) for a in right]).T
    table = Counter(map(tuple, votes.astype(int)))
    post = quality.estimate(sorted(table.items()))
    said = np.array([post[tuple(v)] >= 0.5 for v in votes.astype(int)])
    majority = np.array([(v == 1).sum() >= (v == 0).sum() for v in votes])
    assert (said == truth).mean() > max(0.9, (majority == truth).mean())
    assert quality.estimate([]) == {}


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_posterior_agrees_with_held_out_labels(spark, sf):
    d = f"/root/testdata/{sf}"
    got = quality.judge(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")).toPandas()
    labels = duckdb.sql(f"select doc_id, quality from '{d}/labels.parquet'").df()
    both = got[~got.base_failed].merge(labels, on="doc_id")
    said, truth = both.posterior >= 0.5, both.quality == 1
    assert (said[truth]).mean() > 0.98
    assert (~said[~truth]).mean() > 0.7
