"""Arrow string columns in byte slices of bounded size, cut where no token can cross."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from quantloom.llm.words import text_buffer

#: Bytes of text handled at once.
SLICE_BYTES = 8 << 20
_LOOK = 1 << 16


def slices(column: pa.Array, safe: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first document, bytes, bounds of its documents in them) for runs of about ``size`` bytes of the column.

    A long document is cut too, before a byte that ``safe`` (256 truth values) marks; without any such byte it stays
    whole.  Bounds of a cut document are those of its part.
    """
    data, offsets = text_buffer(column)
    at, end = int(offsets[0]), int(offsets[-1])
    while at < end:
        stop = min(at + size, end)
        if stop < end:
            border = int(offsets[np.searchsorted(offsets, stop)])
            for look in range(stop, border, _LOOK):
                found = np.flatnonzero(safe[data[look : min(look + _LOOK, border)]])
                if len(found):
                    border = look + int(found[0])
                    break
            stop = border
        first = int(np.searchsorted(offsets, at, side="right")) - 1
        last = int(np.searchsorted(offsets, stop))
        yield first, data[at:stop], np.clip(offsets[first : last + 1], at, stop) - at
        at = stop


def spans(inside: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the runs of marked bytes, none of which crosses a document's bound."""
    cut = np.zeros(len(inside) + 1, dtype=bool)
    cut[bounds] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | cut[1:-1]
    ends[:-1] &= ~inside[1:] | cut[1:-1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The spans of ``data``, in order and apart from each other, as an Arrow string column."""
    edge = np.zeros(len(data) + 1, dtype=np.int8)
    edge[starts] += 1
    edge[ends] -= 1
    kept = data[np.cumsum(edge[:-1], dtype=np.int8).view(bool)]
    offsets = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(kept))


def lowered(data: np.ndarray) -> np.ndarray:
    """A to Z become a to z; all other bytes stay."""
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
