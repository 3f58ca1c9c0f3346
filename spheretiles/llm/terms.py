"""Runs of letters of whole texts, counted in slices: strings stay Arrow dictionaries, never Python objects for each run."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True


def runs(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The maximal runs of bytes where `inside`, lower-cased in A-Z, as a dictionary array, and the text that each is in."""
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1] | edge[1:-1]
    closes[:-1] &= ~inside[1:] | edge[1:-1]
    starts, size = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    size -= starts
    ends = np.append(0, np.cumsum(size)).astype(np.int64)
    strings = pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(LOWER[data[inside]].tobytes())])
    return strings.dictionary_encode(), np.searchsorted(offsets, starts, "right") - 1


def counted(codes: np.ndarray, doc: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, code, times) of every code, of `width`, and the text it is in."""
    pair, times = np.unique(doc * width + codes, return_counts=True)
    return pair // width, pair % width, times
