"""Elias-Fano encoding of an ascending list of non-negative integers, with select.

A value's low ``width`` bits stand in a packed array; its high part is written in unary
in a bit array that has one set bit per value: value i's bit is at (high part + i). The
position of every ``STEP``-th set bit is kept, so ``select`` starts near its answer. The
whole takes about 2 + log2(range / count) bits a value."""

from __future__ import annotations

import struct

import numpy as np

STEP = 256
HEAD = struct.Struct("<QQBQQ")  # count, first value, width, bytes of low bits, bytes of high bits


def encode(values: np.ndarray) -> bytes:
    """``values``: ascending uint64, may repeat."""
    values = np.asarray(values, np.uint64)
    n = len(values)
    if not n:
        return HEAD.pack(0, 0, 0, 0, 0)
    first = int(values[0])
    rest = values - values[0]
    width = max(0, (int(rest[-1]) // n).bit_length() - 1)
    low = np.zeros((n, width), np.uint8)
    for b in range(width):
        low[:, b] = (rest >> np.uint64(b)) & np.uint64(1)
    ones = (rest >> np.uint64(width)).astype(np.int64) + np.arange(n)
    high = np.zeros(int(ones[-1]) + 1, np.uint8)
    high[ones] = 1
    low_bytes = np.packbits(low.ravel(), bitorder="little").tobytes()
    high_bytes = np.packbits(high, bitorder="little").tobytes()
    return HEAD.pack(n, first, width, len(low_bytes), len(high_bytes)) + low_bytes + high_bytes + ones[::STEP].astype("<u4").tobytes()


class EliasFano:
    def __init__(self, data: bytes):
        self.count, self.first, self.width, low, high = HEAD.unpack_from(data)
        at = HEAD.size
        self._low = np.frombuffer(data, np.uint8, low, at)
        self._high = np.frombuffer(data, np.uint8, high, at + low)
        self._samples = np.frombuffer(data, "<u4", -(-self.count // STEP), at + low + high)

    def select(self, i: int) -> int:
        """The i-th value: from the sampled set bit before it, counting set bits byte by byte."""
        at = int(self._samples[i // STEP])
        left = i % STEP
        byte, skip = divmod(at, 8)
        bits = int(self._high[byte]) >> skip << skip
        while (ones := bits.bit_count()) <= left:
            left -= ones
            byte += 1
            bits = int(self._high[byte])
        for _ in range(left):
            bits &= bits - 1
        place = byte * 8 + (bits & -bits).bit_length() - 1
        return self.first + ((place - i) << self.width | self._low_bits(i))

    def _low_bits(self, i: int) -> int:
        if not self.width:
            return 0
        at = i * self.width
        part = int.from_bytes(self._low[at // 8:(at + self.width + 7) // 8].tobytes(), "little")
        return part >> at % 8 & ((1 << self.width) - 1)

    def values(self) -> np.ndarray:
        """All values, as uint64."""
        ones = np.flatnonzero(np.unpackbits(self._high, bitorder="little"))[:self.count]
        out = (ones - np.arange(self.count)).astype(np.uint64) << np.uint64(self.width)
        bits = np.unpackbits(self._low, count=self.count * self.width, bitorder="little").reshape(self.count, self.width)
        for b in range(self.width):
            out |= bits[:, b].astype(np.uint64) << np.uint64(b)
        return out + np.uint64(self.first)
