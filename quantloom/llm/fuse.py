"""Static binary-fuse filters (three segments, eight bits a fingerprint) over 64-bit keys, built and read in NumPy.

A key has one slot in each of three neighbouring segments and is in the filter if its slots' bytes xor to its
fingerprint: nine bits a key, no false negatives, one false positive in 256.  A filter is fixed once built.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np

from quantloom.llm.words import mix

_U = np.uint64
#: Seeds tried; each fails rarely, so running out of them means that something else is wrong.
TRIES = 100


class Filter(NamedTuple):
    seed: int
    segment: int  # slots in a segment, a power of two
    fingerprints: np.ndarray


def _spots(keys: np.ndarray, seed: int, segment: int, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """(three slots of each key, its fingerprint)."""
    h = mix(keys.astype(np.uint64) + _U(seed))
    starts = slots - 2 * segment
    first = ((h >> _U(32)) * _U(starts)) >> _U(32)
    inside = _U(segment - 1)
    second = (first + _U(segment)) ^ ((h >> _U(18)) & inside)
    third = (first + _U(2 * segment)) ^ (h & inside)
    return np.stack([first, second, third], axis=1).astype(np.int64), ((h ^ (h >> _U(32))) & _U(255)).astype(np.uint8)


def _peeled(spots: np.ndarray, slots: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """Rounds of (keys, the slot that each had for itself); None if some keys never get one."""
    n = len(spots)
    counts = np.bincount(spots.ravel(), minlength=slots)
    sums = np.zeros(slots, dtype=np.int64)  # of the numbers of the keys that still use a slot
    np.add.at(sums, spots.ravel(), np.repeat(np.arange(n), 3))
    rounds, left, alone = [], n, np.flatnonzero(counts == 1)
    while len(alone):
        keys, once = np.unique(sums[alone], return_index=True)
        rounds.append((keys, alone[once]))
        left -= len(keys)
        used = spots[keys].ravel()
        np.subtract.at(counts, used, 1)
        np.subtract.at(sums, used, np.repeat(keys, 3))
        alone = np.unique(used[counts[used] == 1])
    return None if left else rounds


def build(keys: np.ndarray) -> Filter:
    """The filter of a set of int64 or uint64 keys; repeats count once, no keys make an empty filter."""
    keys = np.unique(keys.astype(np.uint64))
    n = len(keys)
    if not n:
        return Filter(0, 1, np.zeros(0, np.uint8))
    segment = min(1 << 18, 1 << max(2, math.floor(math.log(n) / math.log(3.33) + 2.25)))
    capacity = round(n * max(1.125, 0.875 + 0.25 * math.log(1_000_000) / math.log(max(n, 2))))
    slots = (max(1, math.ceil(capacity / segment) - 2) + 2) * segment
    for seed in range(1, TRIES + 1):
        spots, marks = _spots(keys, seed * 0x9E3779B97F4A7C1 & (1 << 63) - 1, segment, slots)
        rounds = _peeled(spots, slots)
        if rounds is not None:
            break
    else:
        raise RuntimeError(f"no seed out of {TRIES} places {n} keys")
    out = np.zeros(slots, dtype=np.uint8)
    for of, slot in reversed(rounds):  # a key's other slots are settled by then, its own is still 0
        out[slot] = marks[of] ^ np.bitwise_xor.reduce(out[spots[of]], axis=1)
    return Filter(seed * 0x9E3779B97F4A7C1 & (1 << 63) - 1, segment, out)


def contains(fuse: Filter, keys: np.ndarray) -> np.ndarray:
    """For each key whether it may be in the filter; never False for one that is."""
    if not len(fuse.fingerprints):
        return np.zeros(len(keys), dtype=bool)
    spots, marks = _spots(keys.astype(np.uint64), fuse.seed, fuse.segment, len(fuse.fingerprints))
    return np.bitwise_xor.reduce(fuse.fingerprints[spots], axis=1) == marks
