"""Stock from a stored state and the tail of the change log.

A :class:`StockBook` keeps the change log as a fact log by the day a change was recorded, and
snapshots: the state of every farm after a day, and of the events that later ones may refer
to (sales and their edits) whether they were applied and given back. The stock of now is the
newest snapshot and a fold of the days after it, so neither the facts nor the earlier log
are read. A change that comes in late, for a day that a snapshot covers, makes that snapshot
and the ones after it unusable: the log's manifest tells the least day of each load, and a
snapshot the loads it was made of. Then the newest one before the late day is used, or none
and the whole log is folded."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from henhouse.operators import ledger as L
from henhouse.plans import stock as ST
from henhouse.sources.keyed import FactLog, _Versioned

SIZES = ST.SIZES
ALL_MODES = {L.ADD, L.REJECT, L.CLAMP, L.RESTORE, L.REPLACE, L.SET}
STATE = "farm_id long, " + ", ".join(f"{s} long" for s in SIZES) + ", updated_at timestamp_ntz"
OUTCOME = "farm_id long, op_id string, applied boolean, spent boolean"
SCHEMA_DAY = "op_date"


class StockBook:
    def __init__(self, spark: SparkSession, root: str, schema=None):
        """Opens the book at ``root``; ``schema`` is that of ``stock.stock_log``, for a new one."""
        self.spark, self.root = spark, root
        self._snapshots = _Versioned(spark, f"{root}/snapshots")
        self.log = FactLog.open(spark, f"{root}/log", schema) if schema is not None else FactLog(spark, f"{root}/log")

    def record(self, events: DataFrame, writer: str, epoch: int) -> None:
        """Adds changes to the log, once per writer and epoch."""
        self.log.append(events, SCHEMA_DAY, writer, epoch)

    def usable(self) -> dict | None:
        """The newest snapshot that covers all the log has up to its day."""
        lowest = self.log.manifest()["lowest"]
        for version in reversed(self._snapshots.versions()):
            found = self._snapshots.manifest(version)
            if all(day > found["day"] for load, day in lowest.items() if load not in found["loads"] and day != "None"):
                return found
        return None

    def _tail(self, snapshot: dict | None, upto: str | None) -> DataFrame:
        months = (snapshot["day"][:7], "9999-12") if snapshot else None
        rows = self.log.read(months)
        if snapshot:
            rows = rows.filter(F.col(SCHEMA_DAY) > F.lit(snapshot["day"]).cast("date"))
        return rows.filter(F.col(SCHEMA_DAY) <= F.lit(upto).cast("date")) if upto else rows

    def _stored(self, snapshot: dict, kind: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*snapshot[kind])

    def _outcomes(self, snapshot: dict) -> DataFrame:
        """Of every event that may be referred to; what was given back later is said again."""
        return self._stored(snapshot, "outcomes", OUTCOME).groupBy("farm_id", "op_id").agg(
            F.max("applied").alias("applied"), F.max("spent").alias("spent"))

    def tail_fold(self, snapshot: dict | None, upto: str | None = None) -> DataFrame:
        """The changes after a snapshot, folded from its state."""
        if snapshot is None:
            return ST.run(self._tail(None, upto), ALL_MODES)
        return ST.run(self._tail(snapshot, upto), ALL_MODES, initial=self._stored(snapshot, "state", STATE).drop("updated_at"),
                      outcomes=self._outcomes(snapshot))

    def _states(self, snapshot: dict | None, folded: DataFrame) -> DataFrame:
        """The state of every farm: of the fold if it has changes, else of the snapshot."""
        moved = F.greatest(*[F.abs(F.col(f"after_{s}") - F.col(f"before_{s}")) for s in SIZES]) > 0
        last = folded.groupBy("farm_id").agg(
            F.max_by(F.struct(*[F.col(f"after_{s}").alias(s) for s in SIZES]), F.struct(*ST.ORDER)).alias("st"),
            F.max(F.when(moved, F.col("recorded_at"))).alias("changed")).select("farm_id", "st.*", "changed")
        if snapshot is None:
            return last.withColumnRenamed("changed", "updated_at")
        old = self._stored(snapshot, "state", STATE).select("farm_id", *[F.col(s).alias(f"old_{s}") for s in SIZES], "updated_at")
        return last.join(old, "farm_id", "full").select(
            "farm_id", *[F.coalesce(s, f"old_{s}").alias(s) for s in SIZES], F.coalesce("changed", "updated_at").alias("updated_at"))

    def snapshot(self, day: dt.date) -> dict:
        """Stores the state after ``day``, from the newest usable snapshot before it."""
        upto, base = str(day), self.usable()
        if base is not None and base["day"] >= upto:
            return base
        loads = list(self.log.manifest()["files"])
        folder = f"{self.root}/states/{upto}-{len(self._snapshots.versions())}"
        self.tail_fold(base, upto).write.mode("overwrite").parquet(f"{folder}/folded")
        folded = self.spark.read.parquet(f"{folder}/folded")
        self._states(base, folded).write.mode("overwrite").parquet(f"{folder}/state")
        given_back = folded.filter((F.col("mode") == L.RESTORE) & F.col("applied")).select("farm_id", F.col("ref").alias("op_id")).distinct()
        new = folded.filter(F.col("mode").isin(L.REJECT, L.REPLACE)).select("farm_id", "op_id", "applied")
        if base is not None:  # of earlier events only those that were given back since are stored again
            old = self._outcomes(base).join(given_back, ["farm_id", "op_id"], "left_semi").select("farm_id", "op_id", "applied")
            new = new.union(old)
        spent = given_back.withColumn("spent", F.lit(True))
        (new.join(spent, ["farm_id", "op_id"], "left").select("farm_id", "op_id", "applied", F.coalesce("spent", F.lit(False)).alias("spent"))
         .write.mode("overwrite").parquet(f"{folder}/outcomes"))
        before = {"version": (self._snapshots.versions() or [-1])[-1], "epochs": {}}
        return self._snapshots._publish(before, None, None, day=upto, loads=loads, state=[f"{folder}/state"],
                                        outcomes=[*(base["outcomes"] if base else []), f"{folder}/outcomes"])

    def current(self) -> DataFrame:
        """The stock of every farm now: farm_id, a column per size, updated_at (its last change)."""
        snapshot = self.usable()
        return self._states(snapshot, self.tail_fold(snapshot))

    def inventory(self) -> DataFrame:
        """Like ``stock.inventory``, with the time of the farm's last change."""
        now = self.current()
        return ST.inventory_of(now.select("farm_id", F.struct(*SIZES).alias("st"), "updated_at"), "updated_at")
