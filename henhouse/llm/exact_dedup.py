"""Exact de-duplication as a stateful stream.

The rows stream through a keyed aggregation whose state lives in RocksDB, without a
watermark, so no key ever expires: for each digest of the normalised text it retains
the stable identifier of the row that stays (largest doc_id), the locator of its
content (file and row in it) and the number of rows seen. Micro-batches may be of any
size; the state carries over. After the stream has caught up, the state is read as a
table and joined with the rows. Every hit (a row whose digest another row retains)
has its full text compared with the text at the retained locator; digests for which
any comparison fails are decided by the full texts instead.

Only DataFrame operations run: no Python touches a row. Partial aggregation sends one
row per digest and task to the state, and the join with the state is a plain equi-join
whose state side has one row per digest, so a text that a third of all rows share is
split by the skew handling of adaptive execution.

Defined results: a null text counts as empty; a null doc_id is smaller than any other;
of rows with equal text and equal doc_id the one last in (file, row) order stays; an
empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from henhouse.llm.common import written
from henhouse.session import scratch_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Memory for the state of all partitions of an executor; the rest is on its disk.
STATE_MB = 128
#: Where a row's content is: its file and its place in that file.
LOCATOR = ("file", "row")


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _rows(raw: DataFrame, digest: Callable[[Column], Column], *more: Column) -> DataFrame:
    text = normalised(F.col("text"))
    return raw.select(
        F.col("doc_id").cast("long").alias("doc_id"), digest(text).alias("digest"),
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), *more)


def _file_stream(session: SparkSession, path: str, options: dict[str, str]) -> DataFrame:
    """The Parquet table at ``path`` (a folder, or one file) as a stream."""
    at = session._jvm.org.apache.hadoop.fs.Path(path)
    status = at.getFileSystem(session._jsc.hadoopConfiguration()).getFileStatus(at)
    reader = session.readStream.schema(session.read.parquet(path).schema).options(**options)
    if status.isFile():
        return reader.option("pathGlobFilter", at.getName()).parquet(at.getParent().toString())
    return reader.parquet(path)


def stream_state(spark: SparkSession, path: str, digest: Callable[[Column], Column] = sha256,
                 max_files_per_trigger: int | None = None) -> DataFrame:
    """Runs the rows of the Parquet table at ``path`` through the keyed state and returns
    the state: digest, keep (doc_id, file, row), group_size."""
    streams = spark.newSession()
    for key in ("spark.sql.shuffle.partitions", "spark.sql.files.maxPartitionBytes"):
        streams.conf.set(key, spark.conf.get(key))
    streams.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    streams.conf.set("spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage", "true")
    streams.conf.set("spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB", str(STATE_MB))
    streams.conf.set("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", "false")
    # else an executor holds the stores of all its partitions open, and until some time after the stream
    streams.conf.set("spark.sql.streaming.stateStore.unloadOnCommit", "true")
    checkpoint = scratch_path(spark, "exact-dedup-state")
    options = {"maxFilesPerTrigger": str(max_files_per_trigger)} if max_files_per_trigger else {}
    groups = (_rows(_file_stream(streams, path, options), digest)
              .groupBy("digest")
              .agg(F.max(F.struct("doc_id", *LOCATOR)).alias("keep"), F.count("*").alias("n")))
    query = (groups.writeStream.format("noop").outputMode("update")
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
    state = spark.read.format("statestore").load(checkpoint)
    return state.select(F.col("key.digest").alias("digest"), F.col("value.max").alias("keep"),
                        F.col("value.count").alias("group_size"))


def _at(keep: Column) -> Column:
    return (keep["file"] == F.col("file")) & (keep["row"] == F.col("row"))


def _failed_hits(rows: DataFrame, state: DataFrame) -> DataFrame:
    """The digest of each row whose full text differs from the retained row's.
    ``rows`` has the normalised text; only groups of two rows and more take part, and
    only their texts are written and compared."""
    hits = written(rows.join(state.filter("group_size > 1"), "digest")
                   .select("digest", "norm", _at(F.col("keep")).alias("stays")), "exact-dedup-hits")
    kept = hits.filter("stays").select("digest", F.col("norm").alias("kept_norm"))
    return (hits.filter("not stays").join(kept, "digest")
            .filter(F.col("norm") != F.col("kept_norm")).select("digest"))


def decide(spark: SparkSession, path: str, digest: Callable[[Column], Column] = sha256,
           max_files_per_trigger: int | None = None, payload: bool = False) -> DataFrame:
    """One row per row of the Parquet table at ``path``: doc_id, keep_id, group_size,
    kept, text_sha256, source_file, source_row, and with ``payload`` the whole row as
    the struct ``rec``."""
    raw = spark.read.parquet(path)
    more = [F.sha2(normalised(F.col("text")), 256).alias("text_sha256")]
    if payload:
        more.append(F.struct(*[F.col(f"`{c}`") for c in raw.columns]).alias("rec"))
    state = stream_state(spark, path, digest, max_files_per_trigger)
    failed = _failed_hits(_rows(raw, digest, normalised(F.col("text")).alias("norm")), state)
    clash = not failed.isEmpty()
    rows = _rows(raw, digest, *more)
    decided = rows.join(state, "digest")
    if clash:
        failed = failed.distinct()
        by_text = _rows(raw, digest, normalised(F.col("text")).alias("norm"), *more).join(failed, "digest")
        groups = by_text.groupBy("norm").agg(
            F.max(F.struct("doc_id", *LOCATOR)).alias("keep"), F.count("*").alias("group_size"))
        decided = decided.join(failed, "digest", "left_anti").unionByName(
            by_text.join(groups, "norm").drop("norm"))
    out = ["doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", _at(F.col("keep")).alias("kept"),
           "text_sha256", F.col("file").alias("source_file"), F.col("row").alias("source_row")]
    return decided.select(*out, *(["rec"] if payload else []))


def _stored_at(docs: DataFrame) -> str | None:
    """The path of the Parquet table that ``docs`` reads whole, if it is just that."""
    plan = docs._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() != "LogicalRelation":
        return None
    files = plan.relation()
    if files.getClass().getSimpleName() != "HadoopFsRelation" or not files.partitionSchema().isEmpty() \
            or files.fileFormat().getClass().getSimpleName() != "ParquetFileFormat":
        return None
    roots = files.location().rootPaths()
    return roots.head().toString() if roots.size() == 1 else None


def drop_copies(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay, with the columns of ``docs``. A stream reads files: the
    ones that ``docs`` is read from, or, if it is more than a table read whole, those it is
    written to first."""
    path = _stored_at(docs)
    if path is None:
        path = scratch_path(spark, "exact-dedup-input")
        docs.write.parquet(path)
    return decide(spark, path, payload=True, **options).filter("kept").select("rec.*")
