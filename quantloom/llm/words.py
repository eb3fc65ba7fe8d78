"""Vectorised word and shingle hashing over Arrow string columns.

A word is a maximal run of characters other than space and U+0009..U+000D.  Every function here works on one Arrow
batch inside a task, whole documents at a time; a document is never split, so memory follows the longest document and
``CHUNK_BYTES``.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Text bytes hashed at once (a longer document is one chunk of its own).
CHUNK_BYTES = 1 << 20

_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_U = np.uint64


class Words(NamedTuple):
    """Words of consecutive documents: byte spans in ``data``, 64-bit hashes, and each document's first word."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray  # documents + 1 entries


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and document offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data, offsets


def split_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Words of the documents that ``offsets`` delimit in ``data``."""
    base = int(offsets[0])
    data = data[base : int(offsets[-1])]
    bounds = offsets - base
    if not len(data):
        zero = np.zeros(0, np.int64)
        return Words(data, zero, zero, zero.astype(np.uint64), np.zeros(len(bounds), np.int64))
    inside = ~_SEPARATOR[data]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[bounds] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | cut[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | cut[1:-1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    if not len(starts):
        return Words(data, starts, ends, np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64))
    lengths = ends - starts
    at = np.flatnonzero(inside)
    first_byte = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    within = np.arange(len(at)) - np.repeat(first_byte, lengths)
    values = (data[at].astype(np.uint64) + _U(1)) * _powers(int(lengths.max()))[within]
    hashes = mix(np.add.reduceat(values, first_byte) + lengths.astype(np.uint64))
    return Words(data, starts, ends, hashes, np.searchsorted(starts, bounds))


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, Words]]:
    """(first document, one past the last, their words) for runs of documents of about ``size`` bytes."""
    data, offsets = text_buffer(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, split_words(data, offsets[lo : hi + 1])
        lo = hi


def grams(words: Words, n: int, short: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all n-word windows, the word at which each starts, and each document's first window.

    With ``short``, a document of 1 to n - 1 words has one window: all its words.
    """
    h, first = words.hashes, words.first
    counts = np.diff(first)
    windows = np.maximum(counts - n + 1, 0)
    if len(h) >= n:
        g = h[: len(h) - n + 1].copy()
        for j in range(1, n):
            g *= _U(0xD6E8FEB86659FD93)
            g += h[j : len(h) - n + 1 + j]
        g = mix(g)
    else:
        g = np.zeros(0, np.uint64)
    bounds = np.concatenate(([0], np.cumsum(windows)))
    at = np.arange(bounds[-1]) + np.repeat(first[:-1] - bounds[:-1], windows)
    out = g[at]
    if short and (small := np.flatnonzero((counts > 0) & (counts < n))).size:
        extra = [mix(np.bitwise_xor.reduce(mix(h[first[d] : first[d + 1]] + np.arange(counts[d], dtype=np.uint64)), keepdims=True)) for d in small]
        out = np.insert(out, bounds[small], np.concatenate(extra))
        at = np.insert(at, bounds[small], first[small])
        windows[small] = 1
        bounds = np.concatenate(([0], np.cumsum(windows)))
    return out, at, bounds
