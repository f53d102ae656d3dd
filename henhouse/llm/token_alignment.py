"""Alignment of two tokenizers over a corpus, as a pipeline of Arrow tables.

Every text is encoded by a byte-level BPE file (A; of a space and the text) and by a
sentencepiece model (B; which adds the space itself). Both token sequences cover the same
bytes, and two tokens are linked where their byte ranges overlap.

1. *Align* (inside tasks, about ``BLOCK_BYTES`` of text at a time). The id lists are flattened
   and keep the index of their document; segmented cumulative sums of the tokens' byte
   lengths give where each token ends in its document. A full outer hash join of A's and B's
   tokens on (document, end), in the order of the ends, has one row for each link: the tokens
   that end there, or else the next ones to end. Rows found on both sides close a group.
   ``group_by`` turns links into each document's distinct id pairs and how often they occur.
2. *Count.* Each chunk (some ``CHUNK_BYTES`` of text) sends its distinct pairs with their
   partial counts; Spark adds them up over the corpus and finds each B id's highest count.
3. *Score.* Every chunk gets the counts of its own pairs back and joins them with those of
   its documents. No pair table is broadcast, no task holds more than a chunk, and a pair
   that occurs in all documents is one row for each chunk.

The aligned documents are written, so texts are encoded once.

Defined results: a text that is null or empty, or that one of the tokenizers does not give
back byte for byte (the model replaces some characters), has no tokens: zeros and the empty
string. Strings of special tokens inside texts are plain text. Rows that share a doc_id or
are equal are documents of their own, and their links count each; a null doc_id is kept; an
empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from henhouse.llm.common import keyed_texts, written
from henhouse.llm.tokens import ENTRY_BYTES, PART_CHARS, byte_bpe_path, encoder, ship

SPACE = "▁"
#: Bytes of remembered words (B) and parts (A) and their ids: a worker holds at most twice
#: as many.
WORD_BYTES, PART_BYTES = 48 << 20, 64 << 20
BLOCK_BYTES = 1 << 19
CHUNK_BYTES = 8 << 20


def piece_model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


# Vocabularies

def byte_signs() -> dict[str, int]:
    """The byte that each sign of a byte-level vocabulary stands for: printable Latin-1
    signs stand for themselves, the other bytes follow from U+0100 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def level_bytes(token: str, signs: dict[str, int]) -> bytes:
    return bytes(signs[c] for c in token) if all(c in signs for c in token) else token.encode()


def piece_bytes(piece: str) -> bytes:
    if len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">"):
        return bytes([int(piece[3:5], 16)])
    return piece.replace(SPACE, " ").encode()


class Side:
    """One tokenizer: its ids of texts, and the bytes, lengths and decimals of its ids."""

    def __init__(self, tokens: list[bytes]):
        self.size = len(tokens)
        self.bytes = pa.array(tokens, pa.large_binary())
        self.lengths = pa.array([len(t) for t in tokens], pa.int64())
        self.decimals = pa.array([str(i) for i in range(self.size)], pa.large_string())


class LevelSide(Side):
    def __init__(self, name: str):
        self._encoder, signs = encoder(name, plain=True, remembered=PART_BYTES), byte_signs()
        super().__init__([level_bytes(t, signs) for t in self._encoder.vocabulary()])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts with a space before each, and how many each has."""
        found = self._encoder.encode([" " + t for t in texts])
        return np.concatenate([np.zeros(0, np.int32), *found]).astype(np.int32), np.array([len(x) for x in found], np.int64)


class PieceSide(Side):
    """The model's ids. Where none of its pieces has a space after another letter, a single
    space between two words always starts a piece, so the ids of the words, one after the
    other, are those of the text; words recur, and their ids are remembered."""

    def __init__(self, name: str):
        self._load(SparkFiles.get(name))

    def _load(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        self._model = SentencePieceProcessor(model_file=path)
        pieces = [self._model.id_to_piece(i) for i in range(self._model.get_piece_size())]
        with open(path, "rb") as f:
            norm = sentencepiece_model_pb2.ModelProto.FromString(f.read()).normalizer_spec
        self._by_words = (norm.add_dummy_prefix and norm.escape_whitespaces and not norm.remove_extra_whitespaces
                          and not norm.precompiled_charsmap and not any(SPACE in p.lstrip(SPACE) for p in pieces))
        self._young: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}
        self._held = 0
        super().__init__([piece_bytes(p) for p in pieces])

    @staticmethod
    def words(text: str) -> list[str]:
        """``text`` cut at the single spaces that have something else on both sides."""
        pieces = text.split(" ")
        if "" not in pieces:
            return pieces
        out = pieces[:1]
        for before, piece in zip(pieces, pieces[1:]):
            if before and piece:
                out.append(piece)
            else:
                out[-1] += " " + piece
        return out

    def _learn(self, missing: set[str]) -> dict[str, bytes]:
        made = {w: self._old[w] for w in missing if w in self._old}
        rest = [w for w in missing if w not in made]
        made |= zip(rest, (np.array(ids, np.int32).tobytes() for ids in self._model.encode(rest, num_threads=1)))
        kept = {w: ids for w, ids in made.items() if len(w) <= PART_CHARS}
        size = sum(len(w) + len(ids) + ENTRY_BYTES for w, ids in kept.items())
        if self._held + size > WORD_BYTES:
            self._young, self._old, self._held = {}, self._young, 0
        if size <= WORD_BYTES:
            self._young |= kept
            self._held += size
        return made

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not self._by_words or any(SPACE in t for t in texts):
            found = self._model.encode(texts, num_threads=1)
            sizes = np.array([len(x) for x in found], np.int64)
            return np.fromiter(chain.from_iterable(found), np.int32, int(sizes.sum())), sizes
        cut = [self.words(t) for t in texts]
        ids = [list(map(self._young.get, words)) for words in cut]
        missing = {w for words, known in zip(cut, ids) if None in known for w, i in zip(words, known) if i is None}
        made = self._learn(missing) if missing else {}
        blobs = [b"".join([made[w] if i is None else i for w, i in zip(words, known)] if None in known else known) for words, known in zip(cut, ids)]
        return np.frombuffer(b"".join(blobs), np.int32), np.array([len(x) // 4 for x in blobs], np.int64)


_LOADED: dict[tuple[type, str], Side] = {}


def side(kind: type, name: str) -> Side:
    if (kind, name) not in _LOADED:
        _LOADED[kind, name] = kind(name)
    return _LOADED[kind, name]


# Alignment of some texts

def _lists(sizes: np.ndarray, ids: np.ndarray | pa.Array) -> pa.LargeListArray:
    return pa.LargeListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int64()), ids)


def _same_bytes(own: Side, ids: np.ndarray, sizes: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """Which texts the ids give back byte for byte."""
    lengths = np.asarray(own.lengths)[ids]
    sums = np.concatenate(([0], np.cumsum(lengths)))
    at = np.concatenate(([0], np.cumsum(sizes)))
    same = np.diff(sums[at]) == np.array([len(t) for t in texts], np.int64)
    flat = pc.take(own.bytes, pa.array(ids[np.repeat(same, sizes)]))
    given = np.frombuffer(flat.buffers()[2] or b"", np.uint8)[:int(lengths[np.repeat(same, sizes)].sum())]
    want = np.frombuffer(b"".join(t for t, s in zip(texts, same.tolist()) if s), np.uint8)
    wrong = np.flatnonzero(given != want)
    if len(wrong):
        whole = np.flatnonzero(same)
        ends = np.cumsum([len(texts[i]) for i in whole.tolist()])
        same[whole[np.unique(np.searchsorted(ends, wrong, "right"))]] = False
    return same


def _ends(own: Side, lists: pa.LargeListArray, name: str) -> pa.Table:
    """doc, end, and the id, of each token: list index and segmented cumulative sum."""
    ids, doc = pc.list_flatten(lists), pc.list_parent_indices(lists)
    sums = pc.cumulative_sum(pc.take(own.lengths, ids))
    totals = np.concatenate(([0], np.asarray(sums)))[np.asarray(lists.offsets)]
    return pa.table({"doc": doc, "end": pc.subtract(sums, pc.take(pa.array(totals), doc)), name: ids})


def align(a: Side, b: Side, texts: list[str]) -> tuple[dict[str, np.ndarray | list[str]], pa.Table]:
    """For texts that are not empty: n_a, n_b, n_groups, n_links and the groups' digest of
    each, and a table (doc, pair, times) in the order of doc; a pair is A's id times B's
    number of ids plus B's id."""
    ids_a, size_a = a.encode(texts)
    ids_b, size_b = b.encode(texts)
    spaced = [b" " + t.encode() for t in texts]
    same = _same_bytes(a, ids_a, size_a, spaced) & _same_bytes(b, ids_b, size_b, spaced)
    ids_a, ids_b = ids_a[np.repeat(same, size_a)], ids_b[np.repeat(same, size_b)]
    size_a, size_b = np.where(same, size_a, 0), np.where(same, size_b, 0)
    lists_a, lists_b = _lists(size_a, pa.array(ids_a)), _lists(size_b, pa.array(ids_b))
    links = (_ends(a, lists_a, "a").join(_ends(b, lists_b, "b"), ["doc", "end"], join_type="full outer", use_threads=False)
             .sort_by([("doc", "ascending"), ("end", "ascending")]).combine_chunks())
    doc = np.asarray(links["doc"], np.int64)
    in_a, in_b = (np.asarray(pc.is_valid(links[c])) for c in ("a", "b"))
    closes = in_a & in_b
    # groups: the tokens between two common ends, as text
    group, n = np.cumsum(closes) - closes, int(closes.sum())
    comma, bar, semicolon = (pa.scalar(c, pa.large_string()) for c in ",|;")
    joined = [pc.binary_join(_lists(np.bincount(group[mask], minlength=n), pc.take(own.decimals, pa.array(ids))), comma)
              for own, ids, mask in ((a, ids_a, in_a), (b, ids_b, in_b))]
    n_groups = np.bincount(doc[closes], minlength=len(texts))
    whole = pc.binary_join(_lists(n_groups, pc.binary_join_element_wise(*joined, bar)), semicolon)
    digests = [hashlib.sha256(s.as_buffer()).hexdigest() if ok else "" for s, ok in zip(whole, same.tolist())]
    # a link's tokens are those that end there, or the next ones to end
    pair = pc.add(pc.multiply(pc.fill_null_backward(links["a"]).cast(pa.int64()), b.size), pc.fill_null_backward(links["b"]).cast(pa.int64()))
    pairs = (pa.table({"doc": links["doc"], "pair": pair}).group_by(["doc", "pair"], use_threads=False).aggregate([([], "count_all")])
             .sort_by([("doc", "ascending"), ("pair", "ascending")]).rename_columns(["doc", "pair", "times"]))
    counts = {"n_a": size_a, "n_b": size_b, "n_groups": n_groups, "n_links": np.bincount(doc, minlength=len(texts)), "groups_sha256": digests}
    return counts, pairs


COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def aligned(docs: DataFrame, vocabulary: str, model: str) -> DataFrame:
    """One row per document: doc_id, chunk, the counts, groups_sha256, pairs and times."""
    spark = docs.sparkSession
    name_a, name_b = ship(spark, vocabulary), ship(spark, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        a, b = side(LevelSide, name_a), side(PieceSide, name_b)
        first, done = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            sizes = np.asarray(pc.binary_length(batch.column("text")).cast(pa.int64()))
            low = 0
            while low < batch.num_rows:
                high = max(low + 1, low + int(np.searchsorted(np.cumsum(sizes[low:]), BLOCK_BYTES, "right")))
                yield block(a, b, batch.slice(low, high - low), first + done // CHUNK_BYTES)
                done += int(sizes[low:high].sum()) + 64 * (high - low)
                low = high

    def block(a: Side, b: Side, batch: pa.RecordBatch, chunk: int) -> pa.RecordBatch:
        texts = batch.column("text").to_pylist()
        used = np.array([t != "" for t in texts], bool)
        counts, pairs = align(a, b, [t for t in texts if t])
        doc = np.flatnonzero(used)[np.asarray(pairs["doc"], np.int64)]
        sizes = np.bincount(doc, minlength=len(texts))
        columns: list[pa.Array] = [batch.column("doc_id"), pa.repeat(pa.scalar(chunk, pa.int64()), len(texts))]
        for c in COUNTS:
            full = np.zeros(len(texts), np.int64)
            full[used] = counts[c]
            columns.append(pa.array(full))
        digests = iter(counts["groups_sha256"])
        columns.append(pa.array([next(digests) if u else "" for u in used.tolist()], pa.string()))
        offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
        for c in ("pair", "times"):
            columns.append(pa.ListArray.from_arrays(offsets, pairs[c].combine_chunks().cast(pa.int64())))
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "chunk", *COUNTS, "groups_sha256", "pairs", "times"])

    schema = "doc_id long, chunk long, " + ", ".join(f"{c} long" for c in COUNTS) + ", groups_sha256 string, pairs array<long>, times array<long>"
    return keyed_texts(docs, True).select("doc_id", "text").mapInArrow(run, schema)


# Counts over the corpus

def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """chunk, pair, links: the counts of the documents at hand."""
    for batch in batches:
        at = pc.list_parent_indices(batch.column("pairs"))
        table = pa.table({"chunk": pc.take(batch.column("chunk"), at), "pair": pc.list_flatten(batch.column("pairs")),
                          "links": pc.list_flatten(batch.column("times"))})
        found = table.group_by(["chunk", "pair"], use_threads=False).aggregate([("links", "sum")])
        yield from found.select(["chunk", "pair", "links_sum"]).rename_columns(["chunk", "pair", "links"]).combine_chunks().to_batches()


def pair_counts(partial: DataFrame, b_size: int) -> DataFrame:
    """pair, count, best: how many links of the corpus hold the pair, and whether none of
    its B id's other pairs has more."""
    counts = partial.groupBy("pair").agg(F.sum("links").alias("count")).withColumn("b", F.col("pair") % b_size)
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    return counts.join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


RESULT = ("doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", n_best long, count_sum long, groups_sha256 string")


def _scored(docs: pa.Table, counts: pa.Table) -> pa.Table:
    """The documents of one chunk with the counts of their pairs."""
    docs = docs.combine_chunks()
    lists = docs["pairs"].combine_chunks() if docs.num_rows else pa.array([], pa.list_(pa.int64()))
    times = docs["times"].combine_chunks() if docs.num_rows else lists
    links = pa.table({"doc": pc.list_parent_indices(lists), "pair": pc.list_flatten(lists), "times": pc.list_flatten(times)})
    links = links.join(counts.select(["pair", "count", "best"]), "pair", join_type="inner", use_threads=False)
    links = links.append_column("count_sum", pc.multiply(links["times"], links["count"]))
    links = links.append_column("n_best", pc.if_else(links["best"], links["times"], pa.scalar(0, pa.int64())))
    sums = links.group_by("doc", use_threads=False).aggregate([("n_best", "sum"), ("count_sum", "sum")])
    at = np.asarray(sums["doc"], np.int64)
    out = {c: docs[c] for c in ("doc_id", *COUNTS)}
    for c in ("n_best", "count_sum"):
        full = np.zeros(docs.num_rows, np.int64)
        full[at] = np.asarray(sums[f"{c}_sum"])
        out[c] = pa.array(full)
    return pa.table(out | {"groups_sha256": docs["groups_sha256"]})


def token_links(docs: DataFrame, vocabulary: str | None = None, model: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The documents' digests and the corpus-wide table (a, b, count, best)."""
    import sentencepiece

    model = model or piece_model_path()
    b_size = sentencepiece.SentencePieceProcessor(model_file=model).get_piece_size()
    rows = written(aligned(docs, vocabulary or byte_bpe_path(), model), "aligned")
    partial = written(rows.select("chunk", "pairs", "times").mapInArrow(_partial, "chunk long, pair long, links long"), "pair-counts")
    scored = written(pair_counts(partial, b_size), "pair-scores")
    replies = partial.select("chunk", "pair").distinct().join(scored, "pair")
    result = (rows.groupBy("chunk").cogroup(replies.select("chunk", "pair", "count", "best").groupBy("chunk"))
              .applyInArrow(_scored, RESULT))
    table = scored.select(F.expr(f"pair div {b_size}").alias("a"), (F.col("pair") % b_size).alias("b"), "count", "best")
    return result, table


def align_documents(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum,
    groups_sha256."""
    return token_links(docs, **options)[0]
