"""XXH64 of many spans of one buffer at once."""

from __future__ import annotations

import numpy as np

# The primes of XXH64.
P1, P2, P3, P4, P5 = (np.uint64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


def _rot(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc, lane):
    return _rot(acc + lane * P2, 31) * P1


def xxh64(raw: np.ndarray, start: np.ndarray, length: np.ndarray, seed: int) -> np.ndarray:
    """Hash of raw[start : start + length] for every span, unsigned."""
    padded = np.append(raw, np.zeros(40, np.uint8))
    eight = np.ndarray((len(padded) - 7,), "<u8", padded, 0, (1,))
    seed_ = np.uint64(seed)
    at = start.astype(np.int64).copy()
    with np.errstate(over="ignore"):
        h = np.full(len(at), seed_ + P5)
        long = np.flatnonzero(length >= 32)
        if len(long):
            acc = [np.full(len(long), x) for x in (seed_ + P1 + P2, seed_ + P2, seed_, seed_ - P1)]
            stripes, spot, i = length[long] // 32, at[long], 0
            while len(on := np.flatnonzero(stripes > i)):
                for k in range(4):
                    acc[k][on] = _round(acc[k][on], eight[spot[on] + 32 * i + 8 * k])
                i += 1
            merged = _rot(acc[0], 1) + _rot(acc[1], 7) + _rot(acc[2], 12) + _rot(acc[3], 18)
            for a in acc:
                merged = (merged ^ _round(np.uint64(0), a)) * P1 + P4
            h[long] = merged
            at[long] += 32 * stripes
        h += length.astype(np.uint64)
        rest = length % 32
        for i in range(3):
            on = np.flatnonzero(rest >= 8 * (i + 1))
            h[on] = _rot(h[on] ^ _round(np.uint64(0), eight[at[on] + 8 * i]), 27) * P1 + P4
        at += rest // 8 * 8
        rest %= 8
        on = np.flatnonzero(rest >= 4)
        h[on] = _rot(h[on] ^ ((eight[at[on]] & np.uint64(0xFFFFFFFF)) * P1), 23) * P2 + P3
        at[on] += 4
        rest %= 4
        for i in range(3):
            on = np.flatnonzero(rest > i)
            h[on] = _rot(h[on] ^ (padded[at[on] + i].astype(np.uint64) * P5), 11) * P1
        h = (h ^ (h >> np.uint64(33))) * P2
        h = (h ^ (h >> np.uint64(29))) * P3
        return h ^ (h >> np.uint64(32))
