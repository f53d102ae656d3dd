"""Connected components of a graph given as a table of links, as DataFrame joins."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from henhouse.llm.common import written

#: Links that one task contracts before the exchanges begin.
CONTRACT_LINKS = 200_000


class Forest:
    """Union-find; the root of a tree is its least member."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links replaced by stars that connect the same nodes, ``CONTRACT_LINKS`` at a time."""
    forest, n = Forest(), 0

    def stars() -> pa.RecordBatch:
        pairs = [(x, r) for x in list(forest.up) if (r := forest.root(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], ["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            forest.join(a, b)
        n += batch.num_rows
        if n >= CONTRACT_LINKS:
            yield stars()
            forest, n = Forest(), 0
    yield stars()


def _both_ways(links: DataFrame) -> DataFrame:
    return links.union(links.select(F.col("b"), F.col("a")))


def _least(links: DataFrame) -> DataFrame:
    return links.groupBy("a").agg(F.min("b").alias("least"))


def _are_stars(links: DataFrame) -> bool:
    """Whether every node has one link, to a node that has none."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("root")).union(
        links.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("root").alias("root")).filter("out + root > 1").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b; any duplicates and order), root being
    the least node of its component.

    Tasks first contract some links at a time by union-find, which leaves stars. Then
    large-star and small-star steps in turn: each node's greater neighbours, then its
    smaller ones, are tied to the least neighbour, until only stars around the roots are
    left. The least neighbour comes from an aggregate and goes back by an equi-join, so
    a node with any number of links is no single group. Each round is written to the
    shared folder, which keeps the plan short and lost work small."""
    links = written(links.filter("a <> b"), "links")
    tasks = -(-links.count() // CONTRACT_LINKS)
    links = written(links.repartition(max(1, tasks)).mapInArrow(_contract, "a long, b long"), "links")
    while tasks > 1 and not _are_stars(links):
        both = _both_ways(links)
        large = (both.join(_least(both).withColumn("least", F.least("a", "least")), "a")
                 .filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct())
        least = _least(large)
        small = (large.join(least, "a").filter("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
                 .union(least.select("a", F.col("least").alias("b"))).distinct())
        links = written(small, "links")
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        links.select(F.col("b"), F.col("b")).distinct())
