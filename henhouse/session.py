"""Session settings and the shared work folder."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings every job of the engine relies on. AQE re-plans joins from runtime sizes
# (sort-merge -> broadcast only under the threshold), coalesces small shuffle
# partitions and splits skewed ones.
ENGINE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


# Suggested settings for a large cluster (hundreds of executors, ~100 TB of facts).
# Not applied by default: a cluster session brings its own; pass as ``extra``.
#  * many shuffle partitions, coalesced by AQE to ~256 MB each, so the few big
#    shuffles (facts by sale id, by farm) never spill a task;
#  * 512 MB scan splits over date-clustered parquet files;
#  * the broadcast threshold stays the size check for dimension joins;
#  * skewed partitions of a join are split when 5x the median.
CLUSTER_CONF = {
    "spark.sql.shuffle.partitions": "20000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64m",
    "spark.sql.files.maxPartitionBytes": "512m",
    "spark.sql.autoBroadcastJoinThreshold": "64m",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "50000",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "henhouse", extra: dict | None = None) -> SparkSession:
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = dict(ENGINE_CONF)
    conf["spark.ui.enabled"] = "false"
    conf["spark.ui.showConsoleProgress"] = "false"
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``henhouse`` importable by the Python workers (``addPyFile`` of a zip of
    the package, once per application). The folds and stream functions run in
    workers and import helpers from the package; on a cluster the same zip (or a
    wheel via ``--py-files``) is what executors receive."""
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    import zipfile

    pkg = os.path.dirname(os.path.abspath(__file__))
    base = os.path.dirname(pkg)
    out = os.path.join(tempfile.mkdtemp(prefix="henhouse-pkg-"), "henhouse.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, base))
    sc.addPyFile(out)
    _SHIPPED.add(app)


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_let_go(spark: SparkSession) -> Iterator[None]:
    """Inside, a query's shuffle files go when the query ends; otherwise they stay until the
    driver happens to collect its garbage, so those of all steps of a job lie there at once."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def work_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts and written intermediate tables.

    On a cluster this is ``spark.checkpoint.dir`` (a shared file system named by
    the cluster). Only a local session that has none gets a folder of its own, as in
    tests; elsewhere a folder of this machine would be lost to the executors.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if not d:
        d = spark.conf.get("spark.checkpoint.dir", None)
        if not d:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            d = tempfile.mkdtemp(prefix="henhouse-ckpt-")
        sc.setCheckpointDir(d)
        d = sc.getCheckpointDir() or d
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared work folder."""
    import uuid

    base = work_dir(spark)
    return os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}")
