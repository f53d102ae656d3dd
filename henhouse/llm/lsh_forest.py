"""Near duplicates by an LSH forest over MinHash signatures.

Documents are sets of 64-bit hashes of their lower-cased runs of ``WORDS`` words; two link
when 100 * |intersection| >= ``PERCENT`` * |union|. Candidates come from a forest:

1. *Signatures.* A set's signature is ``TREES * DEPTH`` MinHash values of 16 bits. Documents
   with the same set are one class from here on; a class that shares its first values with
   no other in any tree is alone, and goes no further.
2. *Sorted orders.* Tree t orders the classes by their t-th ``DEPTH`` values. Two sets of
   similarity s share the first d of them with probability s ** d, so the classes with the
   longest common prefix are a class's neighbours.
3. *Adaptive depth.* A region is a run of the order that shares a prefix of ``DEPTHS[0]``
   values. A region of more than ``REGION`` classes is split by its next, longer prefixes,
   thin ones stay shallow. What is still larger at full depth shares all ``DEPTH`` values
   and is one family (step 6) without a comparison. Regions with the same members in
   several trees are one.
4. *Candidates.* Inside a region the signatures of all trees estimate similarities; pairs
   less than ``SIGMAS`` standard errors below the threshold are taken most similar first, as
   a spanning forest, so a family of n near copies is n - 1 pairs.
5. *Again.* Where regions were too large at the least depth, the forest is read again with
   the families (components of the candidate pairs) known by then: what counts against
   ``REGION`` is now only the classes outside a region's main family, so the regions of a
   family of near copies end at less depth, where few pairs are missed; the main family is
   dealt into parts that are each compared with all that is outside it. This ends when no
   pair joins two families.
6. *Confirmation.* A candidate pair never leaves a family. In a family all pairs that the
   estimates allow are checked on the full sets where the task has them, most similar
   first; pairs already connected are passed over, and refused pairs are not written.
   Families of more than ``BLOCK`` classes are searched block by block, as in ``ngram_join``.

A pair at the threshold is missed by all trees with a probability under 1e-5 where regions
end at depth 4, 0.02 at depth 8; pairs of higher similarity far less, and a missed pair costs
a link only if no chain of other pairs connects the two. The work of a pass is linear in the
number of documents: a class is compared with ``2 * REGION`` others in each tree at most, and
every table of a pass is linear in that of the trees. The confirmation
of a family of more than a block takes time in the product of its size and the number of
classes outside its largest component.

Defined results: a null or blank text has no shingles and is alone; a document of fewer than
``WORDS`` words is one shingle; rows equal in doc_id and text get equal results; a missing
doc_id names a component only if all of it lack one, and is not ``kept``; an empty table
gives an empty result; other columns are ignored. Shingles and sets are equal when their
64-bit hashes are; signatures are fixed functions of the text, so results are the same in
every run."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from henhouse.llm.common import NULL_ID, extent, keyed_texts, written
from henhouse.llm.components import Forest, components
from henhouse.llm.ngram_join import BLOCK, family_roots, shingle_sets
from henhouse.llm.words import blocks, mix

WORDS, PERCENT = 2, 80
TREES, DEPTH = 24, 12
#: Prefix lengths at which a region may stop; the last is ``DEPTH``.
DEPTHS = (4, 6, 8, DEPTH)
#: Classes compared with each other in one region.
REGION = 256
SIGMAS = 4
#: The part of a region that is one family.
ALL = -1
#: Texts handled at once.
BLOCK_BYTES = 1 << 20

_VALUES = TREES * DEPTH
_FACTORS = (mix(np.arange(1, _VALUES + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_SHIFTS = (mix(np.arange(_VALUES + 1, 2 * _VALUES + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


# Signatures

def minhash(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The signature (16-bit values) of each set that is not empty; sets lie end to end."""
    starts = bounds[:-1][np.diff(bounds) > 0]
    out = np.empty((len(starts), _VALUES), np.uint16)
    if not len(starts):
        return out
    short, own = (values >> np.uint64(32)).astype(np.uint32), np.empty(len(values), np.uint32)
    for k in range(_VALUES):
        np.multiply(short, _FACTORS[k], out=own)
        own += _SHIFTS[k]
        out[:, k] = (np.minimum.reduceat(own, starts) * np.uint32(0x9E3779B1)) >> np.uint32(16)
    return out


SIGNED = "doc_id long, tie long, n_shingles long, cid long, sig binary"


def signatures(texts: DataFrame) -> DataFrame:
    """doc_id, tie, the size of each text's set, its class (a hash of the set) and its
    signature; without shingles neither."""
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, block in blocks(batch, size=BLOCK_BYTES):
                value, bounds = shingle_sets(block, WORDS)
                size = np.diff(bounds)
                with np.errstate(over="ignore"):
                    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(value + np.uint64(11)), dtype=np.uint64)))
                    digest = mix(np.diff(sums[bounds]) + size.astype(np.uint64)).view(np.int64)
                rows = iter(minhash(value, bounds))
                sigs = [next(rows).tobytes() if n else None for n in size.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[a:b], batch.column("tie")[a:b], pa.array(size, pa.int64()), pa.array(digest, mask=size == 0),
                     pa.array(sigs, pa.binary())], ["doc_id", "tie", "n_shingles", "cid", "sig"])

    return texts.mapInArrow(sign, SIGNED)


def in_trees(signed: DataFrame) -> DataFrame:
    """cid, tree, values: the values that order a class in a tree, where it shares the first
    ones with another class. Classes without neighbours in any tree end here."""
    tree = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")
    rows = signed.filter("cid is not null").select("cid", "sig", tree).select(
        "cid", "tree", F.substring(F.col("sig"), F.col("tree") * 2 * DEPTH + 1, F.lit(2 * DEPTH)).alias("values"))
    rows = rows.withColumn("start", F.xxhash64("tree", F.substring("values", 1, 2 * DEPTHS[0])))
    several = written(rows.groupBy("start").agg(F.min("cid").alias("low"), F.max("cid").alias("high")).filter("low < high").select("start"), "forest-starts")
    return written(rows.join(several, "start", "left_semi").select("cid", "tree", "values").distinct(), "forest-trees")


# Regions of the forest

def regions(rest: DataFrame, size: int = REGION, again: bool = False) -> tuple[DataFrame, bool]:
    """region, part, cid: the classes that are compared with each other, region by region,
    and whether any region at the least depth was too large. ``rest``: cid, label (the
    family known so far), tree, values. ``again``: only regions of more than ``size``. Part
    ``ALL`` is a region too large at full depth, which is one family without a comparison."""
    kept, wide = [], False
    for depth in DEPTHS:
        keyed = rest.withColumn("prefix", F.substring("values", 1, 2 * depth))
        members = [F.bit_xor(F.xxhash64(F.lit(s), "cid")).alias(f"members_{s}") for s in (1, 2)]
        if again:
            by_label = keyed.groupBy("tree", "prefix", "label").agg(F.count("*").alias("n"), *members)
            counts = by_label.groupBy("tree", "prefix").agg(
                F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("main"),
                *[F.bit_xor(f"members_{s}").alias(f"members_{s}") for s in (1, 2)]).filter(F.col("n") > size)
        else:  # every class is a family of its own
            counts = (keyed.groupBy("tree", "prefix").agg(F.count("*").alias("n"), F.min("cid").alias("first"), *members).filter("n > 1")
                      .select("tree", "prefix", "n", F.struct(F.lit(1).cast("long").alias("n"), F.col("first").alias("label")).alias("main"),
                              "members_1", "members_2"))
        counts = written(counts, "forest-regions")
        others = F.col("n") - F.col("main.n")
        # the main family is dealt into parts, each compared with all that is outside it
        done = counts.filter((others > 0) & (others < size)).withColumn("whole", F.lit(True))
        left = counts.filter(others >= size)
        if depth == DEPTH:
            done = done.union(left.withColumn("whole", F.lit(False)))
        kept.append((keyed.select("tree", "prefix", "cid", "label"), done.withColumn("region", F.xxhash64(F.lit(depth), "tree", "prefix"))))
        if depth == DEPTH or left.isEmpty():
            break
        wide = True
        rest = keyed.join(left.select("tree", "prefix"), ["tree", "prefix"], "left_semi").select(*rest.columns)
    every = kept[0][1]
    for _, done in kept[1:]:
        every = every.union(done)
    # the same members in several trees, or at several depths: one region
    single = written(every.groupBy("n", "members_1", "members_2").agg(F.min(F.struct("region", "whole", "main")).alias("one"))
                     .select("one.*").select("region", "whole", F.col("main.label").alias("main"),
                                             F.ceil(F.col("main.n") / size).cast("long").alias("parts")),
                     "forest-single")
    members = None
    for rows, done in kept:
        found = (rows.join(done.select("tree", "prefix", "region"), ["tree", "prefix"]).join(single, "region")
                 .withColumn("everywhere", (F.col("parts") > 1) & (F.col("label") != F.col("main"))))
        members = found if members is None else members.union(found)
    own = F.pmod(F.xxhash64("cid"), "parts")
    parts = (F.when(~F.col("whole"), F.array(F.lit(ALL)))
             .when(F.col("everywhere"), F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).otherwise(F.array(own)))
    return written(members.select("region", F.explode(parts).alias("part"), "cid"), "forest-members"), wide


def together(members: DataFrame) -> DataFrame:
    """a, b: the classes of each region ``ALL``, tied to its first."""
    whole = members.filter(F.col("part") == ALL)
    return whole.join(whole.groupBy("region").agg(F.min("cid").alias("b")), "region").filter("cid <> b").select(F.col("cid").alias("a"), "b")


def cutoff(percent: int) -> float:
    """The least estimate of a candidate pair."""
    s = percent / 100
    return s - SIGMAS * math.sqrt(s * (1 - s) / _VALUES)


def candidates(sigs: np.ndarray, sizes: np.ndarray, labels: list[int], percent: int, refused: set[tuple[int, int]],
               forests: int | None) -> list[tuple[int, int]]:
    """Pairs of rows to confirm, most similar first: so many spanning forests over the labels
    (None: all pairs between different labels). ``refused`` pairs are left out."""
    least, found = cutoff(percent) * sigs.shape[1], []
    last = max((i + 1 for i, x in enumerate(labels) if x != labels[-1]), default=0)
    for i in range(last):  # the rows after it share a label
        same = np.count_nonzero(sigs[i + 1:] == sigs[i], axis=1)
        low, high = np.minimum(sizes[i + 1:], sizes[i]), np.maximum(sizes[i + 1:], sizes[i])
        for j in np.flatnonzero((same >= least) & (100 * low >= percent * high)).tolist():
            if labels[i] != labels[i + 1 + j] and (i, i + 1 + j) not in refused:
                found.append((-int(same[j]), i, i + 1 + j))
    found.sort()
    if forests is None:
        return [(i, j) for _, i, j in found]
    out: list[tuple[int, int]] = []
    for _ in range(forests):
        forest, left = Forest(), []
        for pair in found:
            a, b = labels[pair[1]], labels[pair[2]]
            if forest.root(a) != forest.root(b):
                forest.join(a, b)
                out.append(pair[1:])
            else:
                left.append(pair)
        if not left:
            break
        found = left
    return out


def _search(members: DataFrame, percent: int) -> DataFrame:
    """a, b: candidate pairs that connect all that the estimates connect in each part of a
    region. ``members``: region, part, cid, label, n_shingles, sig (one byte a value)."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, group = None, []

        def settle() -> pa.RecordBatch:
            often = Counter(r["label"] for r in group)
            group.sort(key=lambda r: (often[r["label"]], r["label"], r["cid"]))
            pairs = candidates(np.frombuffer(b"".join(r["sig"] for r in group), np.uint8).reshape(len(group), -1),
                               np.array([r["n_shingles"] for r in group]), [r["label"] for r in group], percent, set(), 1) if len(often) > 1 else []
            ends = [sorted((group[i]["cid"], group[j]["cid"])) for i, j in pairs]
            return pa.RecordBatch.from_arrays([pa.array([e[k] for e in ends], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            for r in batch.to_pylist():
                if (r["region"], r["part"]) != at:
                    yield settle()
                    at, group = (r["region"], r["part"]), []
                group.append(r)
        yield settle()

    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (members.select("region", "part", "cid", "label", "n_shingles", "sig").repartition(n, "region", "part")
            .sortWithinPartitions("region", "part", "cid").mapInArrow(task, "a long, b long"))


# Confirmation

def _full_sets(texts: DataFrame) -> DataFrame:
    """cid, shingles of rows (cid, text)."""
    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, block in blocks(batch, size=BLOCK_BYTES):
                value, bounds = shingle_sets(block, WORDS)
                sets = [value[x:y].tobytes() for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                yield pa.RecordBatch.from_arrays([batch.column("cid")[a:b], pa.array(sets, pa.binary())], ["cid", "shingles"])

    return texts.select("cid", "text").mapInArrow(full, "cid long, shingles binary")


def link(own: np.ndarray, other: np.ndarray, percent: int) -> bool:
    """Whether two full sets link."""
    at = np.minimum(np.searchsorted(other, own), len(other) - 1)
    both = int((other[at] == own).sum())
    return 100 * both >= percent * (len(own) + len(other) - both)


def confirmed(group: list[dict], percent: int, labels: list[int], queries: int | None) -> list[tuple[int, int]]:
    """Pairs of ``labels`` that connect all candidate pairs of ``group`` that link on their
    full sets (see ``ngram_join.Pairs``). Pairs already connected are not compared."""
    sigs = np.frombuffer(b"".join(r["sig"] for r in group), np.uint8).reshape(len(group), -1)
    sets = [np.frombuffer(r["shingles"], "<u8") for r in group]
    sizes, least = np.array([len(s) for s in sets]), cutoff(percent) * sigs.shape[1]
    _, root = np.unique(labels, return_inverse=True)  # the component of each row, kept up to date
    out = []
    for i in range(len(group) if queries is None else queries):
        begin = i + 1 if queries is None else queries
        apart = begin + np.flatnonzero(root[begin:] != root[i])
        apart = apart[100 * np.minimum(sizes[apart], sizes[i]) >= percent * np.maximum(sizes[apart], sizes[i])]
        same = np.count_nonzero(sigs[apart] == sigs[i], axis=1)
        order = np.argsort(-same, kind="stable")
        for j in apart[order[same[order] >= least]].tolist():
            if root[i] != root[j] and link(sets[i], sets[j], percent):
                out.append((labels[i], labels[j]))
                root[root == root[j]] = root[i]
    return out


def _one_byte(sig: Column) -> Column:
    """The low byte of each value, for estimates."""
    return F.unhex(F.regexp_replace(F.hex(sig), "(..)..", "$1"))


def _in_wide(trees: DataFrame, size: int) -> DataFrame:
    """The rows of ``trees`` in regions that are too large at the least depth."""
    keyed = trees.withColumn("prefix", F.substring("values", 1, 2 * DEPTHS[0]))
    wide = keyed.groupBy("tree", "prefix").agg(F.count("*").alias("n")).filter(F.col("n") > size)
    return written(keyed.join(wide.select("tree", "prefix"), ["tree", "prefix"], "left_semi").select(*trees.columns), "forest-wide")


def families(brief: DataFrame, trees: DataFrame, percent: int = PERCENT, region: int = REGION) -> DataFrame | None:
    """cid, family: the components of the candidate pairs of all regions; None if there are
    none. ``brief``: cid, n_shingles, sig (one byte a value); ``trees``: cid, tree, values."""
    known, links, roots, again = brief.withColumn("label", F.col("cid")), None, None, False
    rest = trees.withColumn("label", F.col("cid"))
    while True:
        members, wide = regions(rest, region, again)
        labels = known.select("cid", "label")
        tied = (together(members).join(labels.select(F.col("cid").alias("a"), F.col("label").alias("label_a")), "a")
                .join(labels.select(F.col("cid").alias("b"), F.col("label").alias("label_b")), "b")
                .filter("label_a <> label_b").select("a", "b"))
        fresh = written(_search(members.filter(F.col("part") != ALL).join(known, "cid"), percent).union(tied), "forest-found")
        some = not fresh.isEmpty()
        if some:
            links = fresh if links is None else links.union(fresh)
            roots = written(components(links).select(F.col("node").alias("cid"), "root"), "forest-families")
        if not wide or again and not some:
            return None if links is None else roots.withColumnRenamed("root", "family")
        if not again:
            trees, again = _in_wide(trees, region), True
        known = written(brief.join(roots, "cid", "left").withColumn("label", F.coalesce("root", "cid")).drop("root"), "forest-known") if some else known
        rest = written(trees.join(known.select("cid", "label"), "cid"), "forest-labels")


def linked_classes(classes: DataFrame, trees: DataFrame, texts: DataFrame, percent: int = PERCENT, region: int = REGION,
                   block: int = BLOCK) -> DataFrame:
    """(cid, root) of every class in a family. ``classes``: cid, n_shingles, sig; ``trees``:
    cid, tree, values; ``texts``: cid, text."""
    brief = written(classes.select("cid", "n_shingles", _one_byte(F.col("sig")).alias("sig")), "forest-brief")
    found = families(brief, trees, percent, region)
    if found is None:
        return classes.sparkSession.createDataFrame([], "cid long, root long")
    sets = _full_sets(texts.join(found.select("cid"), "cid", "left_semi"))
    return family_roots(sets.join(brief.select("cid", "sig"), "cid"), found, percent, block, confirmed)


def near_components(docs: DataFrame, percent: int = PERCENT, region: int = REGION, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    unique, _ = extent(docs)
    texts = keyed_texts(docs, unique).withColumn("doc_id", F.coalesce("doc_id", F.lit(NULL_ID)))
    single = texts if unique else texts.dropDuplicates(["doc_id", "tie"])
    signed = written(signatures(single), "forest-signatures")
    key, named = ["doc_id", "tie"], F.when(F.col("doc_id") != NULL_ID, F.col("doc_id"))
    trees = in_trees(signed)
    shared = signed.join(trees.select("cid").distinct(), "cid", "left_semi")
    classes = written(shared.groupBy("cid").agg(F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"), F.min(F.struct(*key)).alias("one"))
                      .select("cid", "n_shingles", "sig", "one.*"), "forest-classes")
    own_texts = single.join(classes.select("cid", *key), key).select("cid", "text")
    roots = linked_classes(classes, trees, own_texts, percent, region, block)
    result = (signed.select(*key, "n_shingles", "cid").join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid")))
    least = result.filter("root is not null").groupBy("root").agg(F.min(named).alias("component_id"))
    result = (result.join(least, "root", "left").withColumn("component_id", F.when(F.col("n_shingles") == 0, named).otherwise(F.col("component_id")))
              .select(*key, "n_shingles", "component_id"))
    if not unique:
        rows = texts.select(*key).alias("r")
        result = rows.join(result.alias("f"), [F.col(f"r.{c}") == F.col(f"f.{c}") for c in key]).select("r.*", "f.n_shingles", "f.component_id")
    return result.select(named.alias("doc_id"), "n_shingles", "component_id", F.coalesce(named == F.col("component_id"), F.lit(False)).alias("kept"))
