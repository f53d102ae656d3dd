"""The registered queries over whole tables: their columns, one row per document or page
(or gapless pieces), and DuckDB where SQL states them."""

import duckdb
import pytest

import __spark_entry__ as E
from henhouse.llm import registry

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_consensus_extract": ["page_id", "url", "text", "n_chars"],
    "op2_super_kmer_dedup": ["doc_id", "n_words", "n_removed", "kept_sha256"],
    "op3_ngram_join": ["doc_id", "n_shingles", "component_id"],
    "op4_sentencepiece": ["doc_id", "n_tokens", "ids_crc32", "n_byte_pieces", "decoded_sha256"],
    "op5_weak_supervision": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior"],
    "op6_suffix_dedup": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op7_histogram_shards": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op8_token_files": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op9_pack": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    "op10_exact_dedup": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"],
    "op11_token_alignment": ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
    "op12_lsh_forest": ["doc_id", "n_shingles", "component_id", "kept"],
    "op13_merkle_manifest": ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
}


def test_all_are_listed():
    assert set(registry.queries()) == set(COLUMNS) <= set(E.queries())
    assert "pipeline" in E.queries()


@pytest.mark.parametrize("name", COLUMNS)
def test_columns_and_rows(spark, name):
    df = E.queries()[name](spark, SF)
    assert df.columns == COLUMNS[name]
    rows = df.collect()
    if name != "op9_pack":
        assert len(rows) == spark.read.parquet(f"{SF}/{'pages' if name == 'op1_consensus_extract' else 'documents'}.parquet").count()
    if sql := E.oracle_sql().get(name):
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
        want = con.execute(f"SELECT {', '.join(COLUMNS[name])} FROM ({sql})").fetchall()
        assert sorted(map(tuple, rows)) == sorted(want)
