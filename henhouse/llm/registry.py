"""The queries of this subpackage and, where SQL can state them, their DuckDB form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from henhouse.llm import exact_dedup, html_extract, lsh_forest, merkle, ngram_join, oracles, packing, quality, sentencepiece_codec, sharding, substring_dedup, suffix_dedup, token_alignment, token_files
from henhouse.llm.common import table
from henhouse.session import ship_package

QueryFn = Callable[[SparkSession, str], DataFrame]


def op1_consensus_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op2_super_kmer_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.component_of_each(table(spark, sf_dir, "documents"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.digests(table(spark, sf_dir, "documents"))


def op5_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "posterior")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op7_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards_by_bytes(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.documents_via_files(table(spark, sf_dir, "documents"))


def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return exact_dedup.decide(spark, f"{sf_dir}/documents.parquet").select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align_documents(table(spark, sf_dir, "documents"))


def op12_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh_forest.near_components(table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


OP10_SQL = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM n WINDOW g AS (PARTITION BY t)
"""


def queries() -> dict[str, QueryFn]:
    return {f.__name__: f for f in (
        op1_consensus_extract, op2_super_kmer_dedup, op3_ngram_join, op4_sentencepiece, op5_weak_supervision, op6_suffix_dedup, op7_histogram_shards, op8_token_files, op9_pack, op10_exact_dedup,
        op11_token_alignment, op12_lsh_forest, op13_merkle_manifest,
    )}


def oracle_sql() -> dict[str, str]:
    return {"op2_super_kmer_dedup": oracles.repeats(), "op3_ngram_join": oracles.near_copies(5), "op10_exact_dedup": OP10_SQL,
            "op12_lsh_forest": oracles.near_copies(2, ", doc_id = min(other) AS kept"), "op13_merkle_manifest": oracles.manifest()}
