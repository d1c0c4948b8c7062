"""XXH64 of many byte slices at once."""

from __future__ import annotations

import numpy as np
import xxhash

# Fixed values of the published algorithm.
P1, P2, P3, P4, P5 = (
    0x9E3779B185EBCA87,
    0xC2B2AE3D27D4EB4F,
    0x165667B19E3779F9,
    0x85EBCA77C2B2AE63,
    0x27D4EB2F165667C5,
)
_1, _2, _3, _4, _5 = (np.uint64(x) for x in (P1, P2, P3, P4, P5))


def _rotl(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def _short(data: np.ndarray, at: np.ndarray, length: int, seed: int) -> np.ndarray:
    """Slices of one length under 32 bytes."""
    eight = np.ndarray((max(len(data) - 7, 0),), "<u8", data, strides=(1,))
    four = np.ndarray((max(len(data) - 3, 0),), "<u4", data, strides=(1,))
    h = np.full(len(at), (seed + P5 + length) % (1 << 64), np.uint64)
    done = 0
    while length - done >= 8:
        h ^= _rotl(eight[at + done] * _2, 31) * _1
        h = _rotl(h, 27) * _1 + _4
        done += 8
    if length - done >= 4:
        h ^= four[at + done].astype(np.uint64) * _1
        h = _rotl(h, 23) * _2 + _3
        done += 4
    while done < length:
        h ^= data[at + done].astype(np.uint64) * _5
        h = _rotl(h, 11) * _1
        done += 1
    h ^= h >> np.uint64(33)
    h *= _2
    h ^= h >> np.uint64(29)
    h *= _3
    return h ^ (h >> np.uint64(32))


def xxh64(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of data[starts[i]:ends[i]] as uint64; ``data`` is a contiguous uint8 array."""
    lengths = ends - starts
    out = np.empty(len(starts), np.uint64)
    kinds = np.minimum(lengths, 32).astype(np.uint8)
    order = np.argsort(kinds, kind="stable")
    cuts = np.searchsorted(kinds[order], np.arange(33))
    for length in range(32):
        which = order[cuts[length] : cuts[length + 1]]
        if len(which):
            out[which] = _short(data, starts[which], length, seed)
    rest = order[cuts[32] :]
    if len(rest):
        view, digest = memoryview(data), xxhash.xxh64_intdigest
        out[rest] = np.fromiter((digest(view[a:b], seed) for a, b in zip(starts[rest].tolist(), ends[rest].tolist(), strict=True)), np.uint64, len(rest))
    return out
