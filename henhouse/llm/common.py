"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from henhouse.session import scratch_path, ship_package

#: Order of a missing doc_id: before every other document.
NULL_ID = -(1 << 63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed_texts(docs: DataFrame, unique_ids: bool = False, *carried: Column) -> DataFrame:
    """``doc_id``, ``tie``, ``text`` of ``docs`` (null text: empty), and ``carried``.

    (doc_id, tie) is the key of a document: ``tie`` hashes the text, so rows that share
    a doc_id but not the text stay apart in a fixed order, and rows equal in both are
    one document seen twice. A key made of content is the same in every retry. Where
    doc_ids are known to be unique, ``tie`` is 0. Other columns, whatever their names,
    are left behind."""
    text = F.coalesce(F.col("text"), F.lit(""))
    tie = F.lit(0).cast("long") if unique_ids else F.xxhash64(text)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), tie.alias("tie"), text.alias("text"), *carried)


def extent(docs: DataFrame) -> tuple[bool, int]:
    """Whether doc_ids are unique (and none is missing), and the bytes of all texts."""
    each = docs.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    r = each.agg(F.max("n").alias("n"), F.sum("bytes").alias("bytes"),
                 F.sum(F.col("doc_id").isNull().cast("int")).alias("missing")).first()
    return (r["n"] or 0) <= 1 and not r["missing"], r["bytes"] or 0


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: later jobs read the files, so a
    lost executor costs no recomputation of what came before."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
