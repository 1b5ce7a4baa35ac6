"""Words and word shingles of byte texts as 64-bit fingerprints, in numpy.

Edge cases: null, empty and blank texts have no words and no shingles; a text with fewer words than a
shingle has one shingle of all of them; equal texts give equal results wherever they stand.
"""

from __future__ import annotations

import numpy as np

from sedimark.llm.common import mix64
from sedimark.llm.prints import word_names

_SEPARATOR = np.zeros(256, np.bool_)
_SEPARATOR[[32, *range(9, 14)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprint, document, start byte, end byte) of each lower-cased word, in order."""
    n = len(raw)
    none = np.zeros(0, np.int64)
    if not n:
        return np.zeros(0, np.uint64), none, none, none
    gap = _SEPARATOR[raw]
    after_gap = np.concatenate([[True], gap[:-1]])
    inner = offsets[1:-1]
    after_gap[inner[inner < n]] = True
    start = np.flatnonzero(after_gap & ~gap)
    before_gap = np.concatenate([gap[1:], [True]])
    cut = offsets[1:] - 1
    before_gap[cut[cut >= 0]] = True
    end = np.flatnonzero(before_gap & ~gap) + 1
    return word_names(_FOLD[raw], start, gap), np.searchsorted(offsets, start, "right") - 1, start, end


def shingles(raw: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprint, document, number of the first word in its document) of each shingle.

    A document with 1 to ``size`` - 1 words has one shingle, all its words; without words it has none.
    """
    name, doc, _, _ = words(raw, offsets)
    n_docs = len(offsets) - 1
    counts = np.bincount(doc, minlength=n_docs)
    firsts = np.cumsum(counts) - counts
    place = np.arange(len(name)) - firsts[doc]
    total = np.zeros(len(name), np.uint64)
    odd = np.uint64(0x2545F4914F6CDD1D)
    scales = [np.uint64(pow(int(odd), k + 1, 1 << 64)) for k in range(size)]
    for k, scale in enumerate(scales):
        total[: max(0, len(name) - k)] += name[k:] * scale
    full = place + size <= counts[doc]
    short = np.flatnonzero((counts > 0) & (counts < size))
    out, whose, at = mix64(total[full]), doc[full], place[full]
    if len(short):
        few = np.zeros(len(short), np.uint64)
        for k, scale in enumerate(scales):
            has = counts[short] > k
            few[has] += name[firsts[short[has]] + k] * scale
        few += counts[short].astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)
        out = np.concatenate([out, mix64(few)])
        whose = np.concatenate([whose, short])
        at = np.concatenate([at, np.zeros(len(short), np.int64)])
    return out, whose, at


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprints, number in each document): the distinct shingles, ascending in each document."""
    name, doc, _ = shingles(raw, offsets, size)
    order = np.lexsort((name, doc))
    name, doc = name[order], doc[order]
    fresh = np.ones(len(name), np.bool_)
    fresh[1:] = (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])
    return name[fresh], np.bincount(doc[fresh], minlength=len(offsets) - 1)
