"""Words and lines of many texts at once, as numpy arrays over their UTF-8 bytes.

A word is a longest run of bytes other than space, tab, \\n, \\v, \\f and \\r. Words are
compared by 64-bit hashes (a polynomial of the bytes, then a mixing step), which code
that must be exact follows with a comparison of the bytes themselves."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a single longer text is handled alone.
BLOCK_BYTES = 2 << 20
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_POWERS: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of uint64 (splitmix64's finisher)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse mod 2**64, at least ``n`` of each."""
    if len(_POWERS["up"]) < n:
        size = max(n, 1 << 16)
        for key, base in (("up", int(_BASE)), ("down", pow(int(_BASE), -1, 1 << 64))):
            p = np.ones(size, np.uint64)
            done, step = 1, base  # base ** done
            with np.errstate(over="ignore"):
                while done < size:
                    part = min(done, size - done)
                    p[done:done + part] = p[:part] * np.uint64(step)
                    done += part
                    step = pow(base, done, 1 << 64)
            _POWERS[key] = p
    return _POWERS["up"], _POWERS["down"]


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Sums of (value + 1) * base**place before each place; for ``span_hash``."""
    up, _ = _powers(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    own = out[1:]
    own[:] = values
    with np.errstate(over="ignore"):
        own += np.uint64(1)
        own *= up[:len(values)]
        np.cumsum(own, out=own)
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each span's values that doesn't depend on where the span stands."""
    _, down = _powers(len(sums))
    with np.errstate(over="ignore"):
        return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


class Texts:
    """Texts laid end to end: ``data`` (uint8), text i from ``ends[i]`` to ``ends[i + 1]``."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        self.data, self.bounds = data, bounds
        self.count = len(bounds) - 1
        self._sums: np.ndarray | None = None
        solid = ~SPACE[data]
        before, after = np.zeros_like(solid), np.zeros_like(solid)
        before[1:], after[:-1] = solid[:-1], solid[1:]
        inner = bounds[(bounds > 0) & (bounds < len(data))]
        before[inner] = False
        after[inner - 1] = False
        self.solid = solid
        #: Where words start and end, and the first word of each text.
        self.starts = np.flatnonzero(solid & ~before)
        self.ends = np.flatnonzero(solid & ~after) + 1
        self.first = np.searchsorted(self.starts, bounds)

    def per_text(self, mask: np.ndarray) -> np.ndarray:
        """How many bytes of each text are set in ``mask``."""
        sums = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=sums[1:])
        return np.diff(sums[self.bounds])

    @property
    def sums(self) -> np.ndarray:
        if self._sums is None:
            self._sums = prefix_sums(self.data)
        return self._sums

    def word_hashes(self) -> np.ndarray:
        return span_hash(self.sums, self.starts, self.ends)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.count), np.diff(self.first))


def windows(first: np.ndarray, words: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Start (a word number) and hash of every window of ``n`` consecutive words of one
    text; ``first`` has the first word of each text."""
    whole = len(words) - n + 1
    if whole <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    acc = words[:whole].copy()
    with np.errstate(over="ignore"):
        for k in range(1, n):
            acc = acc * np.uint64(0xD6E8FEB86659FD93) + words[k:whole + k]
    ok = np.ones(whole, bool)
    left = np.repeat(first[1:], np.diff(first))[:whole] - np.arange(whole)  # words to the text's end
    ok[left < n] = False
    starts = np.flatnonzero(ok)
    return starts, mix(acc[starts])


def covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of ``n`` places lie in a window of ``length`` from one of the (distinct) starts."""
    edge = np.zeros(n + 1, np.int32)
    edge[starts] += 1
    edge[starts + length] -= 1
    return np.cumsum(edge[:n]) > 0


def of_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and bounds of a string column; a null is empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, bounds, data = column.buffers()
    bounds = np.frombuffer(bounds, kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[bounds[0]:bounds[-1]], bounds - bounds[0]


def blocks(batch: pa.RecordBatch, column: str = "text", size: int = BLOCK_BYTES) -> Iterator[tuple[int, int, Texts]]:
    """The rows of ``batch`` in blocks of about ``size`` bytes: first row, end row, texts."""
    if not batch.num_rows:
        return
    data, bounds = of_column(batch.column(column))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + size, "right")) - 1)
        yield at, end, Texts(data[bounds[at]:bounds[end]], bounds[at:end + 1] - bounds[at])
        at = end
