"""Words of whole texts as NumPy arrays, straight from Arrow buffers.

A word is a maximal run of bytes other than space, tab, line feed, vertical tab, form feed and carriage
return, so words are found on UTF-8 bytes without decoding. Each word gets a 64-bit polynomial hash.
Every function here works on one Arrow batch inside a task; nothing is kept between batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEPARATORS = b" \t\n\v\f\r"
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[list(SEPARATORS)] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_BASE = 0x9E3779B97F4A7C15
_BLOCK = 1 << 19
LONG = 256  # bytes of a word above which its hash is folded from those of its parts
_powers: dict[tuple[int, bool], np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer, element by element."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: int, n: int, inverse: bool = False) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64 (of the inverse of base if asked). base is odd."""
    table = _powers.get((base, inverse))
    if table is None or len(table) < n:
        size = max(n, 1 << 16)
        step = pow(base, -1, 1 << 64) if inverse else base
        table = np.full(size, step, dtype=np.uint64)
        table[0] = 1
        table = np.multiply.accumulate(table)
        if size <= _BLOCK * 4:
            _powers[base, inverse] = table
    return table[:n]


def rolling(values: np.ndarray, width: int, base: int) -> np.ndarray:
    """Rabin-Karp hash of every run of `width` consecutive values, mixed at the end."""
    n = len(values)
    if n < width:
        return np.empty(0, np.uint64)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values * powers(base, n), out=total[1:])
    return mix((total[width:] - total[:-width]) * powers(base, n - width + 1, inverse=True))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts (or binaries), and the offsets of each in them; a null one is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
    offsets = offsets.astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of data[s:e]; blocks of about _BLOCK bytes bound the memory.

    Polynomials modulo 2**64 have known pairs of strings with equal hashes, of 1024 bytes and more; so longer words are
    cut into parts of LONG bytes, whose mixed hashes are folded.
    """
    long = np.flatnonzero(ends - starts > LONG)
    if not len(long):
        return _plain(data, starts, ends)
    short = np.minimum(ends, starts + LONG)
    out = _plain(data, starts, short)
    for w in long.tolist():
        s = np.arange(starts[w] + LONG, ends[w], LONG)
        h = int(out[w])
        for part in _plain(data, s, np.minimum(s + LONG, ends[w])).tolist():
            h = (h * 0xD6E8FEB86659FD93 + part) & 0xFFFFFFFFFFFFFFFF
            h ^= h >> 29
        out[w] = h
    return mix(out) if len(long) == len(out) else np.where(ends - starts > LONG, mix(out), out)


def _plain(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        low = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, low + _BLOCK, "right")))
        n = int(ends[to - 1] - low)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((data[low : low + n].astype(np.uint64) + np.uint64(1)) * powers(_BYTE_BASE, n), out=total[1:])
        s, e = starts[at:to] - low, ends[at:to] - low
        out[at:to] = mix((total[e] - total[s]) * powers(_BYTE_BASE, n, inverse=True)[s] + (e - s).astype(np.uint64))
        at = to
    return out


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends, first): words of document d are first[d]:first[d+1]; starts and ends are byte places."""
    if lower:
        data = _LOWER[data]
    inside = _IS_WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    opens = inside.copy()
    opens[1:] &= ~inside[:-1] | edge[1:-1]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return _hashed(data, starts, ends), starts, ends, np.searchsorted(starts, offsets)


def pieces(batch: pa.RecordBatch, text: str = "text", limit: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose texts have about `limit` bytes together (a longer text comes alone)."""
    if not batch.num_rows:
        return
    column = batch.column(batch.schema.get_field_index(text))
    size = np.cumsum(pc.fill_null(pc.binary_length(column.cast(pa.large_binary())), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        before = size[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(size, before + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def owner(first: np.ndarray) -> np.ndarray:
    """Index of the document of each item, from the first item of each document."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def distinct(values: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each document, ordered by document and value, and the first of each document."""
    order = np.lexsort((values, doc))
    values, doc = values[order], doc[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (doc[1:] != doc[:-1])
    return values[keep], np.searchsorted(doc[keep], np.arange(n_docs + 1))


def shingles(data: np.ndarray, offsets: np.ndarray, width: int = 5, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of the `width`-word shingles of each text; a text of fewer words has its whole sequence as one."""
    hashes, _, _, first = words(data, offsets, lower)
    n_docs = len(offsets) - 1
    doc = owner(first)
    rolled = rolling(hashes, width, 0xD6E8FEB86659FD93)
    inside = doc[: len(rolled)] == doc[width - 1 :] if len(rolled) else np.empty(0, bool)
    values, where = [rolled[inside]], [doc[: len(rolled)][inside]]
    count = np.diff(first)
    for n in range(1, width):
        short = np.flatnonzero(count == n)
        if len(short):
            part = np.zeros(len(short), np.uint64)
            for j in range(n):
                part = mix(part * np.uint64(0xD6E8FEB86659FD93) + hashes[first[short] + j] + np.uint64(n))
            values.append(part)
            where.append(short)
    return distinct(np.concatenate(values), np.concatenate(where), n_docs)
