"""A Merkle manifest of a dataset that stores only every few levels of its trees.

Each document is a leaf: the SHA-256 of its encoded fields. The leaves of one language, in
ascending order of doc_id, are the bottom of a tree whose nodes hash ``ARITY`` consecutive
nodes (the last run fewer, even one) until one is left, the language's subroot (a lone leaf
is its own). The subroots, ordered by language, are the bottom of the tree of the root.

*Checkpoint.* A tree is written at every ``STEP``-th level only: a stored node stands for an
aligned subtree of at most ``ARITY ** STEP`` nodes of the stored level below it. Ranks come
from one range exchange, so a language with a third of all rows is many partitions.

*Recompute.* Proofs go from the top down, one stored level at a time. The task that meets an
aligned subtree hashes its missing interior levels again from the stored nodes below, adds
each one's siblings to the path of the subtree's root, and forgets them. No task holds more
than one such subtree, and the paths of inner levels are a small share of the leaves.

*Verification.* A document's leaf, tampered with where ``tamper`` says so, is folded along
the path of siblings and compared with the root.

Defined results: a null field is written ``-``; a null language is a tree of its own, the
first; rows that share a doc_id are in the order of their leaves, and rows equal in all five
fields are leaves of their own; a missing doc_id stands first and is never tampered with; an
empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from henhouse.llm.common import written

ARITY = 8
#: Levels from one stored level to the next.
STEP = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Key of the tree over the subroots.
TOP = "top"


def field(value: Column) -> Column:
    """``-``, or the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(text: Column) -> Column:
    parts = [field(F.col(f"`{c}`")) for c in FIELDS[:-1]]
    return F.sha2(F.concat(*parts, field(text)), 256)


def lowered(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def third_of_ids(doc_id: Column) -> Column:
    """Whether 3 divides the CRC-32 of the decimal doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0, F.lit(False))


def leaves(docs: DataFrame, tamper=third_of_ids) -> DataFrame:
    """tree (the language, marked so that null comes first), doc_id, node, altered: the leaf
    as it is and as it would be after tampering."""
    text = F.col("text")
    changed = tamper(F.col("doc_id")) & (text != lowered(text))
    node = leaf(text)
    return docs.select(
        F.coalesce(F.concat(F.lit("1"), F.col("lang")), F.lit("0")).alias("tree"),
        F.col("doc_id").cast("long").alias("doc_id"), node.alias("node"),
        F.when(changed, leaf(lowered(text))).alias("altered"))


# Ranks and stored levels

def numbered(nodes: DataFrame, order: list[str], name: str) -> DataFrame:
    """``nodes`` with ``at``, the place in its tree by ``order``, and ``size``, the number of
    the tree's nodes. A place is the place in a range partition plus the rows of the tree
    in earlier partitions; trees and partitions are windowed, never rows."""
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    row = F.monotonically_increasing_id()
    table = written(nodes.repartitionByRange(n, "tree", *order).sortWithinPartitions("tree", *order)
                    .withColumn("part", F.shiftright(row, 33)).withColumn("row", row.bitwiseAND(F.lit((1 << 33) - 1))), name)
    runs = table.groupBy("tree", "part").agg(F.min("row").alias("low"), F.count("*").alias("n"))
    tree = Window.partitionBy("tree")
    earlier = tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("tree", "part", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("low")).alias("shift"),
                       F.sum("n").over(tree).alias("size"))
    return table.join(runs, ["tree", "part"]).withColumn("at", F.col("row") + F.col("shift")).drop("part", "row", "shift")


def digest(nodes: list[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def interior(nodes: list[str], levels: int) -> list[list[str]]:
    """The levels of an aligned subtree, from ``nodes`` up to ``levels`` above them."""
    out = [nodes]
    for _ in range(levels):
        below = out[-1]
        out.append([digest(below[i:i + ARITY]) for i in range(0, len(below), ARITY)])
    return out


def by_one(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows as Python values one at a time: a row is a whole subtree."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def height(size: int) -> int:
    """Levels above ``size`` nodes until one is left, ``STEP`` at most."""
    return sum(size > ARITY ** i for i in range(STEP))


def subtrees(level: DataFrame, *more: str) -> DataFrame:
    """The aligned subtrees over a stored level: tree, size, above (the place of the node
    that stands for it), and its nodes in order, with the columns ``more``."""
    above = F.shiftright("at", STEP * (ARITY.bit_length() - 1)).alias("above")
    return (level.groupBy("tree", "size", above)
            .agg(F.array_sort(F.collect_list(F.struct("at", "node", *more))).alias("nodes")))


def stored_levels(bottom: DataFrame, name: str) -> list[DataFrame]:
    """The stored levels of every tree: tree, at, node, size. A tree is in a level only while
    more than one of its nodes is left below; ``bottom`` is the first."""
    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = [interior([x["node"] for x in row["nodes"]], height(row["size"]))[-1][0] for row in by_one(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("tree"), batch.column("above"), pa.array(nodes, pa.string()), batch.column("size")],
                                             ["tree", "at", "node", "size"])

    levels, wide = [bottom], bottom.agg(F.max("size")).first()[0] or 0
    while wide > 1:
        up = subtrees(levels[-1].filter("size > 1").select("tree", "at", "node", "size")).mapInArrow(
            tops, "tree string, at long, node string, size long")
        levels.append(written(up.withColumn("size", F.ceil(F.col("size") / ARITY ** STEP).cast("long")), name))
        wide = -(-wide // ARITY ** STEP)
    return levels


def roots(levels: list[DataFrame]) -> DataFrame:
    """tree, node: the last node of every tree."""
    ends = [x.filter("size = 1").select("tree", "node") for x in levels]
    out = ends[0]
    for e in ends[1:]:
        out = out.union(e)
    return out


# Proofs

def siblings(levels: list[list[str]], at: int) -> list[tuple[str, str]]:
    """What stands before and after the node at ``at`` in its run, level by level."""
    out = []
    for nodes in levels[:-1]:
        low = at - at % ARITY
        out.append(("".join(nodes[low:at]), "".join(nodes[at + 1:low + ARITY])))
        at //= ARITY
    return out


def fold(node: str, path: list[tuple[str, str]]) -> str:
    for before, after in path:
        node = hashlib.sha256((before + node + after).encode()).hexdigest()
    return node


PATH = "array<struct<before:string,after:string>>"


def inner_paths(levels: list[DataFrame], ends: DataFrame, name: str) -> DataFrame:
    """tree, at, path of the nodes right above the bottom: one per aligned subtree of leaves.
    ``ends`` has tree and path of every tree's last node."""
    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in by_one(batch):
                up = interior([x["node"] for x in row["nodes"]], height(row["size"]))
                rest = [(p["before"], p["after"]) for p in row["path"]]
                paths = [siblings(up, i) + rest for i in range(len(row["nodes"]))]
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(pa.scalar(row["tree"], pa.string()), len(paths)), pa.array([x["at"] for x in row["nodes"]], pa.int64()),
                     pa.array([[{"before": b, "after": a} for b, a in p] for p in paths], kind)], ["tree", "at", "path"])

    kind = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
    known = None
    for level in reversed(levels[1:]):
        # trees that end here take the path of their end; the others that of the subtree's node
        here = level.filter("size = 1").join(ends, "tree").select("tree", "at", "path")
        if known is not None:
            below = subtrees(level.filter("size > 1")).join(
                known.withColumnRenamed("at", "above"), ["tree", "above"])
            here = here.union(below.mapInArrow(extend, f"tree string, at long, path {PATH}"))
        known = written(here, name)
    lone = levels[0].filter("size = 1").join(ends, "tree").select("tree", "at", "path")
    return lone if known is None else known.union(lone)


def proofs(levels: list[DataFrame], ends: DataFrame, name: str, *more: str) -> DataFrame:
    """The aligned subtrees of leaves with the path above each: tree, size, nodes (with the
    columns ``more``), path."""
    above = inner_paths(levels, ends, name).withColumnRenamed("at", "above")
    return subtrees(levels[0], *more).join(above, ["tree", "above"])


def top_tree(subroots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The root (one row: node), and of each subroot the path to it (tree, path)."""
    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in by_one(batch):
                up = interior([x["node"] for x in row["nodes"]], height(row["size"]))
                rest = [(p["before"], p["after"]) for p in row["path"]]
                found = [siblings(up, i) + rest for i in range(len(row["nodes"]))]
                yield pa.RecordBatch.from_pylist(
                    [{"tree": x["lang_tree"], "path": [{"before": b, "after": a} for b, a in p]} for x, p in zip(row["nodes"], found)],
                    pa.schema([("tree", pa.string()), ("path", pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())])))]))

    bottom = numbered(subroots.select(F.lit(TOP).alias("tree"), F.col("tree").alias("lang_tree"), "node"), ["lang_tree"], "merkle-subroots")
    levels = stored_levels(bottom, "merkle-top")
    start = subroots.sparkSession.createDataFrame([(TOP, [])], f"tree string, path {PATH}")
    found = proofs(levels, start, "merkle-top-paths", "lang_tree").mapInArrow(paths, f"tree string, path {PATH}")
    return roots(levels).select("node"), written(found, "merkle-subroot-paths")


RESULT = "doc_id long, leaf string, proof_sha256 string, folded_root string, subroot string"


def manifest(docs: DataFrame, tamper=third_of_ids) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256 (of the siblings from
    the leaf up to the root), folded_root and whether it is the root."""
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in by_one(batch):
                nodes = row["nodes"]
                up = interior([x["node"] for x in nodes], height(row["size"]))
                rest = [(p["before"], p["after"]) for p in row["path"]]
                out = []
                for i, x in enumerate(nodes):
                    path = siblings(up, i) + rest
                    out.append((x["doc_id"], x["node"], digest([s for p in path for s in p]),
                                fold(x["altered"] or x["node"], path), row["subroot"]))
                columns = [pa.array([r[k] for r in out], pa.int64() if k == 0 else pa.string()) for k in range(5)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "leaf", "proof_sha256", "folded_root", "subroot"])

    bottom = numbered(written(leaves(docs, tamper), "merkle-leaves"), ["doc_id", "node"], "merkle-level-0")
    levels = stored_levels(bottom, "merkle-level")
    subroots = written(roots(levels), "merkle-language-roots")
    root, ends = top_tree(subroots)
    rows = (proofs(levels, ends, "merkle-paths", "doc_id", "altered")
            .join(subroots.withColumnRenamed("node", "subroot"), "tree")
            .select("nodes", "size", "path", "subroot").mapInArrow(verify, RESULT))
    return rows.select("doc_id", "leaf", "subroot", root.scalar().alias("root"), "proof_sha256", "folded_root",
                       (F.col("folded_root") == root.scalar()).alias("verified"))
