"""XXH64 of many spans of one buffer: spans of one length are hashed together, a numpy operation for all of them."""

from __future__ import annotations

import numpy as np
import xxhash

U64 = np.uint64
# fixed values: the primes of the published algorithm
P1, P2, P3, P4, P5 = (U64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
#: Lengths with fewer spans, and longer spans, go through the library one by one.
FEW, LONG = 16, 512
#: Spans that are worked on at once.
BLOCK = 1 << 16


def _rotl(x: np.ndarray, n: int) -> np.ndarray:
    return (x << U64(n)) | (x >> U64(64 - n))


def _round(lane: np.ndarray | np.uint64, k: np.ndarray) -> np.ndarray:
    return _rotl(lane + k * P2, 31) * P1


def _same_length(buf: np.ndarray, start: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Hashes of ``buf[s : s + n]`` for all s; ``buf`` has 8 bytes behind the last span."""
    wide = np.ndarray((len(buf) - 7,), "<u8", buf, 0, (1,))  # the 8 bytes from each position on
    at, seed64 = 0, U64(seed)
    if n >= 32:
        lanes = [np.full(len(start), s, U64) for s in (seed64 + P1 + P2, seed64 + P2, seed64, seed64 - P1)]
        while at + 32 <= n:
            lanes = [_round(v, wide[start + (at + 8 * i)]) for i, v in enumerate(lanes)]
            at += 32
        h = sum(_rotl(v, r) for v, r in zip(lanes, (1, 7, 12, 18)))
        for v in lanes:
            h = (h ^ _round(U64(0), v)) * P1 + P4
    else:
        h = np.full(len(start), seed64 + P5, U64)
    h = h + U64(n)
    while at + 8 <= n:
        h = _rotl(h ^ _round(U64(0), wide[start + at]), 27) * P1 + P4
        at += 8
    if at + 4 <= n:
        h = _rotl(h ^ (wide[start + at] & U64(0xFFFFFFFF)) * P1, 23) * P2 + P3
        at += 4
    for i in range(at, n):
        h = _rotl(h ^ buf[start + i].astype(U64) * P5, 11) * P1
    h = (h ^ (h >> U64(33))) * P2
    h = (h ^ (h >> U64(29))) * P3
    return h ^ (h >> U64(32))


def xxh64_spans(data: bytes, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """The XXH64 of each ``data[start[i] : end[i]]``."""
    buf = np.frombuffer(data + bytes(8), np.uint8)
    out = np.zeros(len(start), U64)
    with np.errstate(over="ignore"):
        for begin in range(0, len(start), BLOCK):
            s, n = start[begin : begin + BLOCK], (end - start)[begin : begin + BLOCK]
            order = np.argsort(n, kind="stable")
            cuts = np.r_[0, np.flatnonzero(np.diff(n[order])) + 1, len(order)]
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                own = order[i:j]
                length = int(n[own[0]])
                if j - i < FEW or length > LONG:
                    out[begin + own] = [xxhash.xxh64_intdigest(data[a : a + length], seed) for a in s[own].tolist()]
                else:
                    out[begin + own] = _same_length(buf, s[own], length, seed)
    return out
