"""Words of many texts at once, as 64-bit hashes, in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: An odd multiplier, its inverse modulo 2^64, and a random odd value for each byte.
_MUL = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))
#: Bytes hashed at a time: a few 8-byte arrays of this length are held.
STEP = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads the bits of 64-bit integers."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _upto(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        _powers = tuple(np.cumprod(np.r_[np.uint64(1), np.full(n - 1, m)]) for m in (_MUL, _INV))
    return _powers[0][:n], _powers[1][:n]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): the words of text i, lower-cased in A-Z, are hashes[offsets[i]:offsets[i + 1]].

    Words are runs of bytes other than space and 0x09-0x0D. `texts` holds no nulls.
    """
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    gap = _GAP[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[ends] = True
    start = ~gap
    start[1:] &= gap[:-1] | edge[1:-1]
    stop = ~gap
    if len(data):
        stop[:-1] &= gap[1:] | edge[1:-1]
    first, last = np.flatnonzero(start), np.flatnonzero(stop) + 1
    out, k = np.empty(len(first), np.uint64), 0
    while k < len(first):
        lo = first[k]
        upto = max(k + 1, int(np.searchsorted(last, lo + STEP, side="right")))
        hi = last[upto - 1]
        power, inverse = _upto(hi - lo + 1)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(_BYTE[_LOWER[data[lo:hi]]] * power[:-1], out=sums[1:])
        out[k:upto] = (sums[last[k:upto] - lo] - sums[first[k:upto] - lo]) * inverse[first[k:upto] - lo]
        k = upto
    return mix(out), np.searchsorted(first, ends)
