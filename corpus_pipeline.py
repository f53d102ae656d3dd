"""The corpus pipeline: documents in, packed training sequences out.

Each stage gets what its predecessor kept, as written Parquet, and returns rows with the
columns of documents; the last returns the placed pieces. ``doc_id`` stays the key all
the way; ``n_chars`` follows the text where a stage shortens it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from henhouse.llm import exact_dedup, ngram_join, packing, quality, suffix_dedup
from henhouse.session import scratch_path, ship_package


#: An executor runs all stages in the same Python workers: memory that a stage no longer
#: uses goes back to the system, not into allocators that keep it for the next.
WORKER_ENV = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "2",
              "MALLOC_MMAP_THRESHOLD_": str(4 << 20), "MALLOC_TRIM_THRESHOLD_": str(16 << 20)}


def prepare(spark: SparkSession) -> None:
    ship_package(spark)
    spark.sparkContext.environment.update(WORKER_ENV)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    prepare(spark)
    return quality.keep_good(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id."""
    return exact_dedup.drop_copies(spark, docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by shared shingles, the one with the smallest doc_id."""
    prepare(spark)
    return ngram_join.keep_one_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings that start earlier in the corpus."""
    prepare(spark)
    return suffix_dedup.shorten(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 2048 ids."""
    prepare(spark)
    return packing.pack(docs, remembered=40 << 20)  # earlier stages hold memory of the executor too


STAGES = [("quality_rules", quality_rules), ("exact_copies", exact_copies), ("near_copies", near_copies),
          ("repeated_passages", repeated_passages), ("packed", packed)]

#: Posteriors, suffix removal and token ids are beyond SQL; tests hold the stages against
#: plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents, each result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
