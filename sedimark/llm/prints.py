"""64-bit names of byte strings, in numpy, without the weak spots of a polynomial modulo 2**64.

Short strings (words) are named by tabulation: a random value for each (place, byte), summed.  Windows of
a text are named by a tree: the name of 2 w bytes mixes the names of its halves, so an order of bytes that
cancels in a polynomial (Thue-Morse words do) doesn't cancel here.

Edge cases: no words and no windows give no names; a text shorter than a window has none; equal strings have
equal names wherever they stand; words of any length are named by all their bytes.
"""

from __future__ import annotations

import numpy as np

from sedimark.llm.common import mix64

_PLACES = 64
_TABLE = mix64(np.arange(_PLACES * 256, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x3C6EF372FE94F82B))
_BYTE = [mix64(np.arange(256, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(seed)) for seed in (11, 29)]
_HALF = np.uint64(0xD6E8FEB86659FD93)
_FAR = np.uint64(0x9FB21C651E98DF25)


def word_names(raw: np.ndarray, start: np.ndarray, gap: np.ndarray) -> np.ndarray:
    """Names of the words that begin at ``start``; bytes marked in ``gap`` belong to no word."""
    if not len(start):
        return np.zeros(0, np.uint64)
    first = int(start[0])
    begin = start.astype(np.int32)
    place = np.arange(first, len(raw), dtype=np.int32) - np.repeat(begin, np.diff(np.append(begin, np.int32(len(raw)))))
    values = _TABLE[(place & np.int32(_PLACES - 1)) << 8 | raw[first:]]
    far = np.flatnonzero((place >= _PLACES) & ~gap[first:])
    if len(far):
        values[far] = mix64(values[far] + (place[far] // _PLACES).astype(np.uint64) * _FAR)
    values[gap[first:]] = 0
    return mix64(np.add.reduceat(values, start - first))


def pair_names(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Names of left halves followed by right halves."""
    x = left * _HALF + right
    x ^= x >> np.uint64(29)
    x *= _FAR
    x ^= x >> np.uint64(32)
    return x


def window_names(raw: np.ndarray, size: int, table: int = 0) -> np.ndarray:
    """Names of all windows of ``size`` bytes, a power of two."""
    names, width = _BYTE[table][raw], 1
    while width < size:
        names = pair_names(names[: max(0, len(names) - width)], names[width:])
        width *= 2
    return names


def span_names(names: np.ndarray, size: int, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Names of spans of at least ``size`` bytes from the names of windows of ``size`` that cover them."""
    out = length.astype(np.uint64) * _FAR + names[start]
    for k in range(1, -(-int(length.max(initial=0)) // size)):
        far = np.flatnonzero(length > k * size)
        at = np.minimum(start[far] + k * size, start[far] + length[far] - size)
        out[far] = pair_names(out[far], names[at])
    return mix64(out)
