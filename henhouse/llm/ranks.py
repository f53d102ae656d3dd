"""Gapless ranks inside groups without a window over a whole group."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from henhouse.llm.common import written


def ranked(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """``df`` with ``rank`` (long): the place of a row inside its ``group`` by ``order``,
    from 0. Rows that tie in ``order`` get distinct ranks.

    One range exchange on (group, order) deals a group over as many partitions as it
    needs; a row's place is its place in its partition plus the rows of its group in
    earlier partitions. The driver sees one count per (partition, group) pair that
    occurs: at most partitions + groups, since partitions are ranges."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = F.monotonically_increasing_id()
    table = written(df.repartitionByRange(n, group, *order).sortWithinPartitions(group, *order)
                    .withColumn("_part", F.shiftright(at, 33).cast("int"))
                    .withColumn("_at", at.bitwiseAND(F.lit((1 << 33) - 1))), name)
    parts = (table.groupBy("_part", group).agg(F.min("_at").alias("low"), F.count("*").alias("n"))
             .orderBy("_part", "low").collect())
    seen: dict = {}
    bases = []
    for p in parts:
        before = seen.get(p[group], 0)
        bases.append((p["_part"], p[group], before - p["low"]))
        seen[p[group]] = before + p["n"]
    kind = df.schema[group].dataType.simpleString()
    # an Arrow table: a list of rows would go through Python workers of another kind, which stay
    columns = [pa.array([b[i] for b in bases]) for i in range(3)]
    base = spark.createDataFrame(pa.table(columns, ["_part", group, "_base"]), f"_part int, {group} {kind}, _base long")
    return (table.join(F.broadcast(base), ["_part", group])
            .withColumn("rank", F.col("_at") + F.col("_base")).drop("_part", "_at", "_base"))
