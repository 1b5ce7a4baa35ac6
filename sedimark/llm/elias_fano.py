"""Elias-Fano coding of a non-decreasing integer sequence, with select.

The coded form holds the low bits, the high bits in unary and one sampled position of the high bits for
every ``SAMPLE`` values; select and blocks of values are answered from these, so no table of all values
is ever made.  An empty sequence is a head alone; equal values are allowed, smaller ones raise.
"""

from __future__ import annotations

import struct

import numpy as np

_HEAD = struct.Struct("<QQBQQQ")
#: One position of every so many set bits is stored; select scans from there.
SAMPLE = 512


class EliasFano:
    """``n`` values below ``universe``: low bits packed, high bits in unary, sampled select."""

    def __init__(self, n: int, universe: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.universe, self.low_bits, self.low, self.high, self.samples = n, universe, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        if n and (np.diff(values.astype(np.int64)) < 0).any():
            raise ValueError("values must not decrease")
        universe = int(values[-1]) + 1 if n else 0
        low_bits = max(0, (universe // n).bit_length() - 1) if n else 0
        if low_bits:
            shifts = np.arange(low_bits, dtype=np.uint64)
            bits = ((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8)
            low = np.packbits(bits.ravel(), bitorder="little")
        else:
            low = np.zeros(0, np.uint8)
        places = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        unary = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
        unary[places] = 1
        return cls(n, universe, low_bits, low, np.packbits(unary, bitorder="little"), places[::SAMPLE].astype(np.uint32))

    def select(self, i: int) -> int:
        """The i-th value, from one sampled block of the high bits."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at = int(self.samples[i // SAMPLE])
        left = i % SAMPLE
        byte = at // 8
        word = int(self.high[byte]) >> (at % 8) << (at % 8)
        while (ones := word.bit_count()) <= left:
            left -= ones
            byte += 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        place = byte * 8 + (word & -word).bit_length() - 1
        return (place - i) << self.low_bits | self._low(i)

    def _low(self, i: int) -> int:
        if not self.low_bits:
            return 0
        first = i * self.low_bits
        last = first + self.low_bits
        block = int.from_bytes(self.low[first // 8 : (last + 7) // 8].tobytes(), "little")
        return block >> (first % 8) & ((1 << self.low_bits) - 1)

    def blocks(self):
        """The values as signed 64-bit integers, SAMPLE at a time, each from its part of the bits."""
        weights = np.int64(1) << np.arange(self.low_bits, dtype=np.int64)
        for k, at in enumerate(self.samples.tolist()):
            first, count = k * SAMPLE, min(SAMPLE, self.n - k * SAMPLE)
            stop = int(self.samples[k + 1]) if k + 1 < len(self.samples) else 8 * len(self.high)
            bits = np.unpackbits(self.high[at // 8 : -(-stop // 8)], bitorder="little")
            places = bits[at % 8 :].nonzero()[0][:count] + at
            values = (places - np.arange(first, first + count)) << self.low_bits
            if self.low_bits:
                start = first * self.low_bits
                low = np.unpackbits(self.low[start // 8 : -(-(start + count * self.low_bits) // 8)], bitorder="little")
                values |= low[start % 8 : start % 8 + count * self.low_bits].reshape(count, self.low_bits).astype(np.int64) @ weights
            yield values

    def decode(self) -> np.ndarray:
        """All values, as signed 64-bit integers."""
        return np.concatenate([np.zeros(0, np.int64), *self.blocks()])

    def to_bytes(self) -> bytes:
        sizes = len(self.low), len(self.high), len(self.samples)
        return _HEAD.pack(self.n, self.universe, self.low_bits, *sizes) + self.low.tobytes() + self.high.tobytes() + self.samples.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, raw: memoryview) -> tuple[EliasFano, int]:
        """(sequence, bytes consumed)."""
        n, universe, low_bits, a, b, c = _HEAD.unpack_from(raw)
        at = _HEAD.size
        low = np.frombuffer(raw[at : at + a], np.uint8)
        high = np.frombuffer(raw[at + a : at + a + b], np.uint8)
        end = at + a + b + 4 * c
        return cls(n, universe, low_bits, low, high, np.frombuffer(raw[at + a + b : end], "<u4")), end
