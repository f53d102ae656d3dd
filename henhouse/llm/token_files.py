"""Token ids as binary files with Elias-Fano document boundaries.

The rows are range-partitioned by doc_id and sorted, so files in the order of their names
hold the documents in ascending order. A task streams its rows through the tokenizer and
starts a new file whenever one is full, so its memory does not grow with the partition.
A file is

    ids         the ids of its documents one after the other, uint16 or uint32 (little-endian)
    doc ids     Elias-Fano list (offset by 2**63, so that they are non-negative)
    boundaries  Elias-Fano list of n + 1 offsets into the ids
    foot        sizes of the two lists, bytes of an id, number of missing doc_ids, magic

Both lists take a few bits a document and answer ``select(i)`` without being unpacked.
A task writes under a name of its own and renames, so a retried or speculative attempt
ends with the same file. The manifest (a row per file) is the only thing the driver sees;
it gives each file the number of ids before it.

Defined results: a null or empty text has the end id alone; rows with the same doc_id
are in the order of their text hash; a null doc_id comes first and reads back as null;
an empty table writes no file; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from henhouse.llm.common import NULL_ID, keyed_texts
from henhouse.llm.elias_fano import EliasFano, encode as elias_fano
from henhouse.llm.tokens import byte_bpe_path, encode, encoder, ship
from henhouse.session import scratch_path

MAGIC = b"HHTOKEF1"
FOOT = struct.Struct("<QQBQ8s")
SHIFT = 1 << 63


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


class _Writer:
    """One file being written."""

    def __init__(self, fs: pafs.FileSystem, path: str, dtype: np.dtype):
        self.fs, self.path, self.dtype = fs, path, dtype
        self.hidden = f"{path}.{uuid.uuid4().hex}.tmp"
        self.out = fs.open_output_stream(self.hidden)
        self.ids, self.ends, self.missing, self.total = [], [0], 0, 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.out.write(ids.astype(self.dtype).tobytes())
        self.missing += doc_id is None
        self.ids.append((NULL_ID if doc_id is None else doc_id) + SHIFT)
        self.total += len(ids)
        self.ends.append(self.total)

    def close(self) -> tuple[str, int, int]:
        docs = elias_fano(np.array(self.ids, np.uint64))
        bounds = elias_fano(np.array(self.ends, np.uint64))
        self.out.write(docs + bounds + FOOT.pack(len(docs), len(bounds), self.dtype.itemsize, self.missing, MAGIC))
        self.out.close()
        self.fs.move(self.hidden, self.path)
        return self.path.rpartition("/")[2], len(self.ids), self.total


def write(docs: DataFrame, folder: str, vocabulary: str | None = None, end_id: int = 2,
          ids_per_file: int = 1 << 24) -> list[tuple[str, int, int, int]]:
    """Writes the ids of all documents; returns the manifest in order: (file name,
    documents, ids, ids in the files before it)."""
    spark = docs.sparkSession
    name = ship(spark, vocabulary or byte_bpe_path())
    fs, root = _filesystem(folder)
    fs.create_dir(root)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _filesystem(folder)
        part, made, writer = TaskContext.get().partitionId(), [], None
        for batch in batches:
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode(name, batch.column("text").to_pylist())):
                if writer is None:
                    writer = _Writer(fs, f"{root}/{part:06d}-{len(made):06d}.ids", encoder(name).dtype)
                writer.add(doc_id, np.append(ids, ids.dtype.type(end_id)))
                if writer.total >= ids_per_file:
                    made.append(writer.close())
                    writer = None
        if writer:
            made.append(writer.close())
        files, n_docs, n_ids = zip(*made) if made else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(n_docs, pa.int64()),
                                          pa.array(n_ids, pa.int64())], ["file", "n_docs", "n_ids"])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = keyed_texts(docs).repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    files = rows.mapInArrow(task, "file string, n_docs long, n_ids long").collect()
    manifest, before = [], 0
    for r in sorted(files):
        manifest.append((r["file"], r["n_docs"], r["n_ids"], before))
        before += r["n_ids"]
    return manifest


class TokenFile:
    """Random access to one file."""

    def __init__(self, uri: str):
        fs, path = _filesystem(uri)
        self._in = fs.open_input_file(path)
        end = self._in.size()
        docs, bounds, self.id_bytes, self.missing, magic = FOOT.unpack(self._in.read_at(FOOT.size, end - FOOT.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is not a token file")
        lists = self._in.read_at(docs + bounds, end - FOOT.size - docs - bounds)
        self.docs, self.bounds = EliasFano(lists[:docs]), EliasFano(lists[docs:])

    def __len__(self) -> int:
        return self.docs.count

    def doc_id(self, i: int) -> int | None:
        return None if i < self.missing else self.docs.select(i) - SHIFT

    def doc_ids(self) -> list[int | None]:
        """All doc_ids; missing ones are the first."""
        ids = (self.docs.values() ^ np.uint64(SHIFT)).view(np.int64).tolist()
        return [None] * self.missing + ids[self.missing:]

    def ids(self, start: int, end: int) -> np.ndarray:
        """The ids from ``start`` up to ``end``, counted in this file."""
        raw = self._in.read_at((end - start) * self.id_bytes, start * self.id_bytes)
        return np.frombuffer(raw, "<u2" if self.id_bytes == 2 else "<u4")

    def document(self, i: int) -> np.ndarray:
        return self.ids(self.bounds.select(i), self.bounds.select(i + 1))


def read(spark: SparkSession, folder: str, manifest: list[tuple[str, int, int, int]]) -> DataFrame:
    """One row per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, before in zip(batch.column("file").to_pylist(), batch.column("before").to_pylist()):
                f = TokenFile(f"{folder}/{file}")
                bounds, doc_ids = f.bounds.values().astype(np.int64), f.doc_ids()
                for at in range(0, len(f), 4096):
                    to = min(at + 4096, len(f))
                    block, low = f.ids(int(bounds[at]), int(bounds[to])).astype("<u4"), bounds[at]
                    cuts = bounds[at:to + 1] - low
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(doc_ids[at:to], pa.int64()), pa.array(bounds[at:to] + before),
                         pa.array(np.diff(cuts)),
                         pa.array([zlib.crc32(block[a:b].tobytes()) for a, b in zip(cuts, cuts[1:])], pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"])

    files = spark.createDataFrame([(f, b) for f, _, _, b in manifest], "file string, before long")
    return (files.repartition(max(1, len(manifest)))
            .mapInArrow(task, "doc_id long, start long, n_tokens long, ids_crc32 long"))


def documents_via_files(docs: DataFrame, **options) -> DataFrame:
    """Writes the files under the shared folder and reads the documents back."""
    folder = scratch_path(docs.sparkSession, "token-files")
    return read(docs.sparkSession, folder, write(docs, folder, **options))
