"""Vectorised words and word hashes of an Arrow batch of texts.

The helpers work on whole UTF-8 buffers, so a task does a handful of numpy
passes per few hundred kilobytes instead of a Python step per word.  Words
are runs of bytes of one class; 64-bit hashes come from one running sum per
buffer and are the same on every machine and in every run.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
#: Texts are taken in slices of about this many bytes (a longer text alone).
SLICE_BYTES = 1 << 19

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def byte_class(pattern: bytes, flags: int = re.DOTALL) -> np.ndarray:
    """Boolean table of the byte values that match a one-byte pattern."""
    rule = re.compile(pattern, flags)
    return np.array([rule.fullmatch(bytes([i])) is not None for i in range(256)])


#: Bytes of words that end at ASCII white space only.
NON_SPACE = byte_class(rb"[^\x20\x09-\x0D]")
#: A-Z to a-z, all else unchanged.
LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8).copy()
SAME = np.arange(256, dtype=np.uint8)


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        have = np.full(size, _U(base))
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 1 << 22:
            _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (multiply-xorshift)."""
    h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and document offsets of a string array; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offsets


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive document ranges of at most ``limit`` bytes each; a single
    longer document makes a range of its own."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


class Words:
    """Words of the documents ``lo`` to ``hi`` of one batch.

    ``starts``/``ends`` are byte positions inside ``data``; the words of the
    i-th document of the slice are ``first[i]:first[i + 1]``.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lo: int, hi: int,
                 member: np.ndarray = NON_SPACE, fold: np.ndarray = SAME):
        base = int(offsets[lo])
        raw = data[base:int(offsets[hi])]
        self.bounds = (offsets[lo:hi + 1] - base).astype(np.int64)
        self.data = raw if fold is SAME else fold[raw]
        n = len(raw)
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = member[self.data]
        opens = inside[1:-1] & ~inside[:-2]
        closes = inside[1:-1] & ~inside[2:]
        # a border between two texts ends a word even without a separator
        border = self.bounds[1:-1]
        border = border[(border > 0) & (border < n)]
        opens[border] = inside[border + 1]
        closes[border - 1] = inside[border]
        self.starts = np.flatnonzero(opens)
        self.ends = np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.starts, self.bounds)

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word's bytes."""
        n = len(self.data)
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        run = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[self.data] * _power(_BASE, n), out=run[1:])
        return mix((run[self.ends] - run[self.starts]) * _power(_INVERSE, n)[self.starts])


_GRAM = [_U(int(x) | 1) for x in np.random.default_rng(7).integers(1, 2**63, 64, dtype=np.uint64)]


def ngrams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` consecutive word hashes (one array in,
    ``len(h) - k + 1`` out; empty when there are fewer words)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, _U(k))
    for i in range(k):
        out += h[i:i + n] * _GRAM[i]
    return mix(out)


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Like :func:`ngrams` for long runs, from a running sum (cost does not
    depend on ``k``)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    run = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * _power(_BASE, len(h)), out=run[1:])
    return mix((run[k:] - run[:-k]) * _power(_INVERSE, len(h))[:n])
