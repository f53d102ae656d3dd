"""SentencePiece encoding and decoding of a table of texts (``pieces`` has the method).

Both directions are maps without an exchange. The model file is sent to the executors once;
a worker builds the automaton once.

Defined results: a null or empty text has no ids and decodes to an empty text; letters
without a piece become byte pieces (or the unknown id, if the model has none); the mark
U+2581 is a space to the model, so it decodes to one; a null list of ids decodes to an
empty text; rows are treated each by itself; other columns are carried.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from henhouse.llm.pieces import PieceModel

_LOADED: dict[str, PieceModel] = {}
#: Characters encoded between two batches handed on.
BATCH_CHARS = 4 << 20


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _ship(df: DataFrame, path: str) -> str:
    df.sparkSession.sparkContext.addFile(path)
    return os.path.basename(path)


def _model(name: str) -> PieceModel:
    if name not in _LOADED:
        with open(SparkFiles.get(name), "rb") as f:
            _LOADED[name] = PieceModel(f.read())
    return _LOADED[name]


def _ranges(sizes: list[int]) -> Iterator[tuple[int, int]]:
    at, size = 0, 0
    for i, n in enumerate(sizes):
        size += n
        if size >= BATCH_CHARS:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(sizes):
        yield at, len(sizes)


def _mapped(df: DataFrame, source: str, target: str, kind: str, arrow: pa.DataType, convert) -> DataFrame:
    """``df`` with the column ``target`` made from ``source``; no other column may be so named."""
    if target in df.columns:
        raise ValueError(f"there is a column {target} already")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(source).to_pylist()
            for a, b in _ranges([len(v) if v else 0 for v in values]):
                made = pa.array([convert(v) for v in values[a:b]], arrow)
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, made], [*batch.schema.names, target])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(task, f"{fields}, `{target}` {kind}")


def encode(docs: DataFrame, path: str | None = None, source: str = "text", target: str = "ids") -> DataFrame:
    """``docs`` with the ids of the column ``source``."""
    name = _ship(docs, path or model_path())
    return _mapped(docs, source, target, "array<int>", pa.list_(pa.int32()), lambda t: _model(name).encode(t or ""))


def decode(docs: DataFrame, path: str | None = None, source: str = "ids", target: str = "decoded") -> DataFrame:
    """``docs`` with the text that the ids of the column ``source`` stand for."""
    name = _ship(docs, path or model_path())
    return _mapped(docs, source, target, "string", pa.string(), lambda ids: _model(name).decode(ids or []))


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_crc32 (unsigned, of the ids as
    little-endian 32-bit integers), n_byte_pieces, and decoded_sha256 of the text that the
    ids decode to. Encodes and decodes in one pass, so the ids need not leave the task."""
    name = _ship(docs, path or model_path())
    out = "doc_id long, n_tokens long, ids_crc32 long, n_byte_pieces long, decoded_sha256 string"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(name)
        is_byte = np.zeros(len(model.pieces), bool)
        is_byte[list(model.bytes_of)] = True
        for batch in batches:
            cols: list[list] = [[], [], [], []]
            for text in batch.column("text").to_pylist():
                ids = model.encode(text or "")
                array = np.array(ids, "<u4")
                for col, v in zip(cols, (len(ids), zlib.crc32(array.tobytes()), int(is_byte[array].sum()),
                                         hashlib.sha256(model.decode(ids).encode()).hexdigest())):
                    col.append(v)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.string())],
                ["doc_id", "n_tokens", "ids_crc32", "n_byte_pieces", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(task, out)
