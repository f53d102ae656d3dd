"""Domain tables as lazily built DataFrames.

Two ways in:

* :meth:`Tables.from_testdata` — the driver's parquet tables through the adapter
  views (used by tests, the oracle check and the bench);
* :meth:`Tables.from_domain` — domain tables stored as parquet (one directory per
  table, facts partitioned by ``year_month``), read with explicit schemas so nothing
  is inferred and filters on the date reach the scan as partition filters.

Nothing is read until an operator asks for a table; Catalyst prunes the columns and
pushes the filters of the operator down to the parquet scan.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from henhouse import schemas
from henhouse.sources.adapter import VIEWS

#: The day of an item's sale, by which stored items are laid out.
ITEM_DATE = "sale_date"


class Tables:
    def __init__(self, spark: SparkSession, loader, raw_reader=None, dated_items=None):
        """``dated_items`` reads the sale items with the day of their sale (``ITEM_DATE``), if
        they are stored by it."""
        self.spark = spark
        self._dated_items = dated_items
        self._loader = loader
        self._raw_reader = raw_reader
        self._cache: dict[str, DataFrame] = {}

    # -- constructors -------------------------------------------------------
    @classmethod
    def from_testdata(cls, spark: SparkSession, sf_dir: str) -> "Tables":
        raw: dict[str, DataFrame] = {}

        def read_raw(name: str) -> DataFrame:
            if name not in raw:
                raw[name] = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
            return raw[name]

        def load(self_: "Tables", name: str) -> DataFrame:
            sql, deps = VIEWS[name]
            frames = {d: (self_.table(d) if d in VIEWS else read_raw(d)) for d in deps}
            return spark.sql(sql, **frames)

        return cls(spark, load, read_raw)

    @classmethod
    def from_domain(cls, spark: SparkSession, root: str) -> "Tables":
        def load(self_: "Tables", name: str) -> DataFrame:
            reader = spark.read.schema(schemas.DOMAIN_SCHEMAS[name])
            return reader.parquet(os.path.join(root, name)).select(
                *schemas.DOMAIN_SCHEMAS[name].fieldNames()
            )

        def dated_items() -> DataFrame:
            fields = [*schemas.SALE_ITEMS.fields, T.StructField(ITEM_DATE, T.DateType())]
            return spark.read.schema(T.StructType(fields)).parquet(os.path.join(root, "sale_items"))

        return cls(spark, load, dated_items=dated_items)

    # -- access -------------------------------------------------------------
    def raw(self, name: str) -> DataFrame:
        """A source table as delivered (test data only)."""
        if self._raw_reader is None:
            raise KeyError(f"no raw table {name!r} in this catalog")
        return self._raw_reader(name)

    def table(self, name: str) -> DataFrame:
        if name not in self._cache:
            self._cache[name] = self._loader(self, name)
        return self._cache[name]

    @property
    def galpones(self) -> DataFrame:
        return self.table("galpones")

    @property
    def users(self) -> DataFrame:
        return self.table("users")

    @property
    def daily_collections(self) -> DataFrame:
        return self.table("daily_collections")

    @property
    def sales(self) -> DataFrame:
        return self.table("sales")

    @property
    def sale_items(self) -> DataFrame:
        return self.table("sale_items")

    @property
    def expenses(self) -> DataFrame:
        return self.table("expenses")

    @property
    def bird_events(self) -> DataFrame:
        return self.table("bird_events")

    def items_between(self, keep: Callable[[str], Column]) -> DataFrame:
        """The items of the sales whose date passes ``keep`` (a function of a date column's
        name), as far as storage can tell: where items are stored by the day of their sale,
        the other folders are not read; elsewhere all items, which the join with the sales
        filters anyway."""
        if self._dated_items is None:
            return self.sale_items
        return self._dated_items().filter(keep(ITEM_DATE)).select(*self.sale_items.columns)

    @cached_property
    def names(self) -> tuple[str, ...]:
        return tuple(VIEWS)


def write_domain(tables: Tables, root: str, mode: str = "overwrite", partition_by: str = "day") -> None:
    """Store the domain tables as parquet with facts partitioned by their business
    date.

    ``partition_by="day"`` uses the date column itself as the partition column, so
    every date predicate of the operators (trailing windows, on-date lists) prunes
    folders with no extra predicate; ``"month"`` adds a ``year_month`` folder level
    for fewer, larger partitions (pruning then relies on parquet min/max statistics,
    kept tight by the range partitioning on the date)."""
    date_col = {
        "daily_collections": "collection_date",
        "sales": "sale_date",
        "expenses": "expense_date",
        "bird_events": "event_date",
    }
    for name in VIEWS:
        df = tables.table(name)
        path = os.path.join(root, name)
        if name == "sale_items":
            # beside the sales: an item lies in the folder of the day its sale has
            days = tables.sales.select(F.col("id").alias("sale_id"), F.col("sale_date").alias(ITEM_DATE))
            df = df.join(days, "sale_id").select(*df.columns, ITEM_DATE)
            df.repartitionByRange(ITEM_DATE, "sale_id").write.mode(mode).partitionBy(ITEM_DATE).parquet(path)
            continue
        if name not in date_col:
            df.write.mode(mode).parquet(path)
            continue
        # Range partitioning on the date splits a busy month over many tasks and
        # keeps each output file clustered by date (tight min/max stats).
        ranged = df.repartitionByRange(date_col[name])
        if partition_by == "day":
            ranged.write.mode(mode).partitionBy(date_col[name]).parquet(path)
        else:
            (ranged.withColumn("year_month", F.date_format(date_col[name], "yyyy-MM"))
             .write.mode(mode).partitionBy("year_month").parquet(path))
