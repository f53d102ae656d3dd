"""Similarity join of documents on word shingles by T-occurrence search.

Documents are sets of 64-bit hashes of their lower-cased runs of ``WORDS`` words; two link
when 100 * |intersection| >= ``PERCENT`` * |union|. The join returns each document's
component under these links, and loses none of them:

1. *Frequencies.* Documents are dealt into chunks of some 16 MB. A chunk sends its distinct
   shingles (sorted, delta-coded, by hash range) to the buckets that count in how many
   documents each occurs, and gets the counts back, on a log scale, in the order sent.
2. *Filter.* A document links only if it shares ``PERCENT`` % of its shingles with another
   one; where fewer than that occur elsewhere at all, it is alone. This leaves copies and
   near copies; only their sets are written.
3. *Classes.* Documents with the same set are one class from here on.
4. *Families.* In the order rarest shingle first, two linked sets share one of their first
   |set| - T + 1 shingles. Classes that share one are in one family (connected components
   over shingle and class); links never leave a family.
5. *Search.* In a family each set asks an inverted index for the sets that hold at least T
   of its shingles: the longest lists are set aside, the short ones are merged on a heap,
   and sets that occur often enough there are looked up in the long ones by binary search
   (DivideSkip). Sets already known to be connected are not compared.
6. Families larger than ``BLOCK`` are searched block by block; then one set of each
   component is compared with those of other blocks; then every set outside the largest
   component is searched in all blocks. All pairs but those inside one component are
   covered, no task holds more than a block of either side, and a family of near copies
   that makes up a third of all rows costs time linear in its size.

Defined results: a null or blank text has no shingles and is alone; a document of fewer
than ``WORDS`` words is one shingle; rows equal in doc_id and text get equal results; a
missing doc_id names a component only if all of it lack one; an empty table gives an empty
result; other columns are ignored. Shingles are equal when their 64-bit hashes are.
"""

from __future__ import annotations

import heapq
import math
import struct
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from henhouse.llm.common import NULL_ID, extent, keyed_texts, written
from henhouse.llm.components import Forest, components
from henhouse.llm.words import Texts, blocks, mix, windows

WORDS, PERCENT = 5, 80
CHUNK_BYTES = 16 << 20
#: Texts handled at once: the arrays over them take some 60 times this.
BLOCK_BYTES = 512 << 10
#: Sets searched together in one task.
BLOCK = 1000
#: Weight of a binary probe against a step of the merge, in the choice of long lists.
PROBE = 0.0085
#: Low bits of a shingle's hash that the counting leaves out.
SHORT = np.uint64(16)
_CODEC = pa.Codec("zstd", compression_level=1)
#: Pairs of labels that connect all that is connected among the rows of a group: rows, percent,
#: labels, and how many rows at the front are searched among the others only (None: all among all).
Pairs = Callable[[list[dict], int, list[int], int | None], list[tuple[int, int]]]


# Sets of shingles

def lowered(texts: Texts) -> Texts:
    data = texts.data
    return Texts(np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8), texts.bounds)


def shingle_sets(texts: Texts, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text in ascending order, and where each text's begin."""
    texts = lowered(texts)
    hashes, of, size = texts.word_hashes(), texts.text_of_word(), np.diff(texts.first)
    starts, found = windows(texts.first, hashes, words)
    owners, values = [of[starts]], [found]
    for k in range(1, words):
        starts, found = windows(texts.first, hashes, k)
        whole = size[of[starts]] == k
        with np.errstate(over="ignore"):
            values.append(mix(found[whole] + np.uint64(k)))
        owners.append(of[starts[whole]])
    owner, value = np.concatenate(owners), np.concatenate(values)
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return value[fresh], np.searchsorted(owner[fresh], np.arange(texts.count + 1))


def _chunk_sets(table: pa.Table, words: int) -> tuple[np.ndarray, np.ndarray]:
    values, sizes = [], []
    for batch in table.select(["text"]).combine_chunks().to_batches():
        for _, _, texts in blocks(batch, size=BLOCK_BYTES):
            value, bounds = shingle_sets(texts, words)
            values.append(value)
            sizes.append(np.diff(bounds))
    empty = np.zeros(0, np.uint64)
    return np.concatenate([empty, *values]), np.concatenate(([0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *sizes]))))


# How often shingles occur

def _packed(*columns: np.ndarray) -> bytes:
    """Arrays of one length, each as planes of bytes, compressed."""
    planes = [c.view(np.uint8).reshape(len(c), -1).T.tobytes() for c in columns]
    raw = b"".join(planes)
    return struct.pack("<II", len(columns[0]), len(raw)) + _CODEC.compress(raw, asbytes=True)


def _unpacked(blob: bytes, *kinds: str) -> list[np.ndarray]:
    n, size = struct.unpack_from("<II", blob)
    raw, at, out = _CODEC.decompress(blob[8:], size, asbytes=True), 0, []
    for kind in kinds:
        width = np.dtype(kind).itemsize
        planes = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel())
        at += n * width
    return out


def _edges(values: np.ndarray, buckets: int) -> np.ndarray:
    """Where the hash range of each bucket begins in the sorted short hashes."""
    span = 1 << (64 - int(SHORT))
    return np.searchsorted(values, np.array([span * b // buckets for b in range(buckets + 1)], np.uint64))


def frequencies(base: DataFrame, buckets: int, words: int) -> DataFrame:
    """For each chunk and bucket the log-scaled counts of the chunk's shingles there."""
    def send(table: pa.Table) -> pa.Table:
        value, _ = _chunk_sets(table, words)
        short, count = np.unique(value >> SHORT, return_counts=True)
        edges = _edges(short, buckets)
        used = np.flatnonzero(np.diff(edges))
        blobs = [_packed(np.diff(short[edges[b]:edges[b + 1]], prepend=np.uint64(0)),
                         np.minimum(count[edges[b]:edges[b + 1]], 65535).astype(np.uint16)) for b in used]
        return pa.table({"bucket": pa.array(used, pa.int64()), "chunk": pa.repeat(table["chunk"][0], len(used)),
                         "blob": pa.array(blobs, pa.binary())})

    def count(table: pa.Table) -> pa.Table:
        parts = [_unpacked(b, "<u8", "<u2") for b in table["blob"].to_pylist()]
        sizes = np.cumsum([len(p[0]) for p in parts])[:-1]
        values = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts])
        counts = np.concatenate([p[1] for p in parts])
        order = np.argsort(values, kind="stable")
        fresh = np.ones(len(order), bool)
        fresh[1:] = values[order[1:]] != values[order[:-1]]
        group = np.cumsum(fresh) - 1
        total = np.bincount(group, counts[order])
        level = np.minimum(255, np.round(8 * np.log2(total))).astype(np.uint8)
        levels = np.empty(len(order), np.uint8)
        levels[order] = level[group]
        return pa.table({"chunk": table["chunk"], "bucket": table["bucket"],
                         "levels": pa.array([_packed(x) for x in np.split(levels, sizes)], pa.binary())})

    return (base.groupBy("chunk").applyInArrow(send, "bucket long, chunk long, blob binary")
            .groupBy("bucket").applyInArrow(count, "chunk long, bucket long, levels binary"))


SETS = ("doc_id long, tie long, n_shingles long, digest_a long, digest_b long, shared boolean, "
        "first array<long>, shingles binary")


def sets_with_filter(base: DataFrame, levels: DataFrame, words: int, percent: int) -> DataFrame:
    """One row per document: the size and a digest of its set; where enough of its shingles
    occur elsewhere, also the set itself and its first (rarest) shingles."""
    def combine(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table([pa.array([], f.type) for f in out], out)
        value, bounds = _chunk_sets(table, words)
        short, back = np.unique(value >> SHORT, return_inverse=True)
        order = np.argsort(np.asarray(replies["bucket"])) if replies.num_rows else []
        blobs = replies["levels"].to_pylist()
        known = np.concatenate([np.zeros(0, np.uint8), *[_unpacked(blobs[i], "u1")[0] for i in order]])
        level = known[back]
        size = np.diff(bounds)
        elsewhere = np.diff(np.concatenate(([0], np.cumsum(level > 0)))[bounds])
        shared = (100 * elsewhere >= percent * size) & (size > 0)
        with np.errstate(over="ignore"):
            digests = [np.diff(np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(value + np.uint64(s)), dtype=np.uint64)))[bounds]).view(np.int64)
                       for s in (11, 23)]
        first, sets = [None] * len(size), [None] * len(size)
        for i in np.flatnonzero(shared).tolist():
            a, b = bounds[i], bounds[i + 1]
            own, own_level = value[a:b], level[a:b]
            n = b - a
            prefix = n - -(-percent * n // 100) + 1
            rarest = np.lexsort((own, own_level))[:prefix]
            first[i] = own[rarest[own_level[rarest] > 0]].view(np.int64)
            sets[i] = own.tobytes()
        return pa.table([table["doc_id"], table["tie"], pa.array(size, pa.int64()), pa.array(digests[0]), pa.array(digests[1]),
                         pa.array(shared), pa.array(first, pa.list_(pa.int64())), pa.array(sets, pa.binary())], out)

    out = pa.schema([("doc_id", pa.int64()), ("tie", pa.int64()), ("n_shingles", pa.int64()), ("digest_a", pa.int64()),
                     ("digest_b", pa.int64()), ("shared", pa.bool_()), ("first", pa.list_(pa.int64())), ("shingles", pa.binary())])
    return base.groupBy("chunk").cogroup(levels.groupBy("chunk")).applyInArrow(combine, SETS)


# T-occurrence search

class Index:
    """Inverted lists over sets numbered in the order they were added."""

    def __init__(self, percent: int):
        self.percent = percent
        self.sets: list[np.ndarray] = []
        self.lists: dict[int, list[int]] = {}

    def add(self, shingles: np.ndarray) -> None:
        for s in shingles.tolist():
            self.lists.setdefault(s, []).append(len(self.sets))
        self.sets.append(shingles)

    def search(self, shingles: np.ndarray, skip) -> Iterator[int]:
        """The sets that link with ``shingles``; those for which ``skip`` says so, at the
        time they come up, are left out."""
        n = len(shingles)
        need = -(-self.percent * n // 100)
        lists = sorted(((len(found), s) for s in shingles.tolist() if (found := self.lists.get(s))), reverse=True)
        if len(lists) < need:
            return
        n_long = min(int(need / (PROBE * math.log2(lists[0][0]) + 1)), need - 1)
        long = np.sort(np.array([s for _, s in lists[:n_long]], np.uint64))
        short = [self.lists[s] for _, s in lists[n_long:]]
        counted = ((sum(1 for _ in same), i) for i, same in groupby(heapq.merge(*short)))
        for seen, i in sorted((c for c in counted if c[0] >= need - n_long), reverse=True):
            other = self.sets[i]
            m = len(other)
            if 100 * min(n, m) < self.percent * max(n, m) or skip(i):
                continue
            at = np.minimum(np.searchsorted(other, long), m - 1)
            both = seen + int((other[at] == long).sum())
            if 100 * both >= self.percent * (n + m - both):
                yield i


def linked(sets: list[np.ndarray], percent: int, labels: list[int], queries: int | None = None) -> list[tuple[int, int]]:
    """Pairs of labels that connect all that is connected among the sets; sets of one label
    count as connected already. With ``queries``, the first so many sets are searched
    among the others only."""
    forest, index, out = Forest(), Index(percent), []
    own: list[int] = []

    def add(i: int) -> None:
        index.add(sets[i])
        own.append(i)

    for i in range(queries, len(sets)) if queries is not None else ():
        add(i)
    for i in range(len(sets) if queries is None else queries):
        for j in index.search(sets[i], lambda j: forest.root(labels[own[j]]) == forest.root(labels[i])):
            out.append((labels[i], labels[own[j]]))
            forest.join(*out[-1])
        if queries is None:
            add(i)
    return out


def by_index(group: list[dict], percent: int, labels: list[int], queries: int | None) -> list[tuple[int, int]]:
    """``linked`` of the sets of ``group``."""
    return linked([np.frombuffer(r["shingles"], "<u8") for r in group], percent, labels, queries)


def _search_groups(rows: DataFrame, keys: list[str], percent: int, pairs: Pairs) -> DataFrame:
    """Searches inside each group of ``rows`` (keys, cid, label, shingles). Gives (label,
    root) of all rows: the least label that its own is connected with in its group. Where
    rows have ``asks``, those that do are searched among the others, and only labels that
    are connected with another come back."""
    two_sided = "asks" in rows.columns

    def settle(group: list[dict]) -> list[tuple[int, int]]:
        if two_sided:
            group.sort(key=lambda r: (not r["asks"], r["cid"]))
        else:
            group.sort(key=lambda r: r["cid"])
        labels = [r["label"] for r in group]
        forest = Forest()
        if len(group) > 1:
            for pair in pairs(group, percent, labels, sum(r["asks"] for r in group) if two_sided else None):
                forest.join(*pair)
        return [(x, forest.root(x)) for x in dict.fromkeys(forest.up if two_sided else labels)]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, group = None, []

        def batch_of(found: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["label", "root"])

        for batch in batches:
            found: list[tuple[int, int]] = []
            for r in batch.to_pylist():
                if (key := tuple(r[k] for k in keys)) != at:
                    found += settle(group)
                    at, group = key, []
                group.append(r)
            yield batch_of(found)
        yield batch_of(settle(group))

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, *keys).sortWithinPartitions(*keys).mapInArrow(task, "label long, root long")


def _families(classes: DataFrame) -> DataFrame:
    """(cid, family): classes that share one of their first shingles."""
    firsts = classes.select("cid", F.explode("first").alias("shingle"))
    centres = firsts.groupBy("shingle").agg(F.min("cid").alias("centre"), F.count("*").alias("n")).filter("n > 1")
    links = firsts.join(centres, "shingle").select(F.col("cid").alias("a"), F.col("centre").alias("b"))
    return components(links).select(F.col("node").alias("cid"), F.col("root").alias("family"))


def family_roots(classes: DataFrame, families: DataFrame, percent: int, block: int, pairs: Pairs = by_index) -> DataFrame:
    """(cid, root) of the classes in ``families`` (cid, family): the component each is in.
    ``classes``: cid, shingles and what else ``pairs`` reads."""
    sizes = families.groupBy("family").agg(F.count("*").alias("members"))
    members = written(
        classes.join(families, "cid").join(sizes, "family")
        .withColumn("blocks", F.ceil(F.col("members") / block).cast("long"))
        .withColumn("block", F.pmod(F.xxhash64("cid"), "blocks")).withColumn("label", F.col("cid")), "members")
    inside = written(_search_groups(members, ["family", "block"], percent, pairs).withColumnRenamed("label", "cid"), "inside")
    large = members.filter("blocks > 1").drop("label")
    if large.isEmpty():
        return inside
    # one set of each component found so far, against those of other blocks
    labelled = written(large.join(inside, "cid").withColumnRenamed("root", "label"), "labelled")
    centres = labelled.filter("cid = label")
    pieces = centres.groupBy("family").agg(F.ceil(F.count("*") / block).cast("long").alias("pieces"))
    across = _search_groups(centres.join(pieces, "family").withColumn("piece", F.pmod(F.xxhash64("cid"), "pieces")),
                            ["family", "piece"], percent, pairs)
    labelled = written(labelled.join(across, "label").drop("label").withColumnRenamed("root", "label"), "labelled")
    # every set outside the largest component, in all blocks
    main = (labelled.groupBy("family", "label").agg(F.count("*").alias("n"))
            .groupBy("family").agg(F.max_by("label", F.struct("n", "label")).alias("main")))
    outside = labelled.join(main, "family").filter("label <> main").drop("main")
    rounds = outside.groupBy("family").agg(F.ceil(F.count("*") / block).cast("long").alias("pieces"))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    cols = ["family", "block", "piece", "asks", "label", *classes.columns]
    asking = (outside.join(rounds, "family").withColumn("piece", F.pmod(F.xxhash64("cid"), "pieces"))
              .withColumn("block", each("blocks")).withColumn("asks", F.lit(True)))
    asked = labelled.join(rounds, "family").withColumn("piece", each("pieces")).withColumn("asks", F.lit(False))
    last = _search_groups(asking.select(*cols).union(asked.select(*cols)), ["family", "block", "piece"], percent, pairs)
    merged = components(last.select(F.col("label").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "label")
    final = (labelled.select("cid", "label").join(merged, "label", "left")
             .select("cid", F.coalesce("root", "label").alias("root")))
    return inside.join(large.select("cid"), "cid", "left_anti").union(final)


def join_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """One row per distinct (doc_id, tie): n_shingles, class (null: alone), component_id."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    unique, size = extent(docs)
    texts = keyed_texts(docs, unique).withColumn("doc_id", F.coalesce("doc_id", F.lit(NULL_ID)))
    if not unique:
        texts = texts.dropDuplicates(["doc_id", "tie"])
    chunks = max(n, -(-size // CHUNK_BYTES))
    base = texts.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "tie"), F.lit(chunks)))
    sets = written(sets_with_filter(base, frequencies(base, chunks, words), words, percent), "shingle-sets")
    digest = ["n_shingles", "digest_a", "digest_b"]
    shared = sets.filter("shared")
    # numbered after the sort by class, once, and then written: the numbers stay as they are
    first = shared.groupBy(*digest).agg(F.min(F.struct("doc_id", "tie")).alias("one"))
    chosen = (shared.join(first, digest).filter((F.col("doc_id") == F.col("one.doc_id")) & (F.col("tie") == F.col("one.tie")))
              .select(*digest, "first", "shingles", "doc_id"))
    classes = written(chosen.withColumn("cid", F.monotonically_increasing_id()), "classes")
    roots = family_roots(classes.select("cid", "shingles"), _families(classes), percent, block)
    named = F.when(F.col("doc_id") != NULL_ID, F.col("doc_id"))
    rooted = classes.select("cid", "doc_id", *digest).join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    least = rooted.groupBy("root").agg(F.min(named).alias("component_id"))
    # a class whose least doc_id is missing may hold another document that has one
    if not unique:
        by_class = shared.groupBy(*digest).agg(F.min(named).alias("named"))
        least = rooted.join(by_class, digest).groupBy("root").agg(F.min("named").alias("component_id"))
    found = rooted.join(least, "root").select(*digest, "root", "component_id")
    return (sets.select("doc_id", "tie", *digest).join(found, digest, "left")
            .withColumn("doc_id", named)
            .withColumn("component_id", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
            .select("doc_id", "tie", "n_shingles", F.col("root").alias("class"), "component_id"))


def component_of_each(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    unique, _ = extent(docs)
    found = join_components(docs, **options)
    if unique:
        return found.select("doc_id", "n_shingles", "component_id")
    rows = keyed_texts(docs).select("doc_id", "tie").alias("r")
    same = [F.col("r.doc_id").eqNullSafe(F.col("f.doc_id")), F.col("r.tie") == F.col("f.tie")]
    return rows.join(found.alias("f"), same).select("r.doc_id", "f.n_shingles", "f.component_id")


def keep_one_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all columns, without the near copies: of each component the
    row with the smallest (doc_id, hash of the text) stays."""
    unique, _ = extent(docs)
    found = join_components(docs, **options)
    least = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "tie")
    stays = (found.filter("class is null").select("doc_id", "tie")
             .union(found.filter("class is not null").groupBy("class").agg(F.min(least).alias("one")).select("one.doc_id", "one.tie")))
    tie = F.lit(0).cast("long") if unique else F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("rec"),
                       F.col("doc_id").cast("long").alias("doc_id"), tie.alias("tie"))
    if not unique:
        rows = rows.dropDuplicates(["doc_id", "tie"])
    same = [F.col("r.doc_id").eqNullSafe(F.col("s.doc_id")), F.col("r.tie") == F.col("s.tie")]
    return rows.alias("r").join(stays.alias("s"), same, "left_semi").select("rec.*")
