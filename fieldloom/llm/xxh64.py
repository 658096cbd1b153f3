"""XXH64 of many byte ranges at once, lane by lane over ranges of equal length."""

from __future__ import annotations

import numpy as np
import xxhash

# Fixed values of the public XXH64 specification.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
#: Longer ranges are rare; each is hashed on its own.
_LONG = 256


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * _P2, 31) * _P1


def _equal_length(buf: np.ndarray, words: np.ndarray, halves: np.ndarray, start: np.ndarray, n: int, seed: int) -> np.ndarray:
    s, at = np.uint64(seed), 0
    with np.errstate(over="ignore"):
        if n >= 32:
            v = [np.full(len(start), x, np.uint64) for x in (s + _P1 + _P2, s + _P2, s, s - _P1)]
            while at + 32 <= n:
                v = [_round(x, words[start + (at + 8 * k)]) for k, x in enumerate(v)]
                at += 32
            acc = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
            for x in v:
                acc = (acc ^ _round(np.zeros_like(x), x)) * _P1 + _P4
        else:
            acc = np.full(len(start), s + _P5, np.uint64)
        acc = acc + np.uint64(n)
        while at + 8 <= n:
            acc = _rotl(acc ^ _round(np.zeros_like(acc), words[start + at]), 27) * _P1 + _P4
            at += 8
        if at + 4 <= n:
            acc = _rotl(acc ^ (halves[start + at].astype(np.uint64) * _P1), 23) * _P2 + _P3
            at += 4
        while at < n:
            acc = _rotl(acc ^ (buf[start + at].astype(np.uint64) * _P5), 11) * _P1
            at += 1
        acc ^= acc >> np.uint64(33)
        acc *= _P2
        acc ^= acc >> np.uint64(29)
        acc *= _P3
        acc ^= acc >> np.uint64(32)
    return acc


def xxh64(buf: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 42) -> np.ndarray:
    """Unsigned XXH64 of every buf[start:end]."""
    out = np.empty(len(start), np.uint64)
    if not len(start):
        return out
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    words = np.lib.stride_tricks.as_strided(padded[:8].view("<u8"), (len(buf) + 1,), (1,))
    halves = np.lib.stride_tricks.as_strided(padded[:4].view("<u4"), (len(buf) + 5,), (1,))
    length = np.minimum(end - start, _LONG + 1).astype(np.int16)
    order = np.argsort(length, kind="stable")
    cut = np.flatnonzero(np.append(True, np.diff(length[order]) > 0))
    for i, j in zip(cut, np.append(cut[1:], len(order)), strict=True):
        rows = order[i:j]
        n = int(length[rows[0]])
        if n > _LONG:
            out[rows] = [xxhash.xxh64_intdigest(padded[a:b].tobytes(), seed=seed) for a, b in zip(start[rows], end[rows], strict=True)]
        else:
            out[rows] = _equal_length(padded, words, halves, start[rows], n, seed)
    return out
