"""Splits texts as the pattern of the byte-level tokenizers does, on arrays, and keeps the ids of pieces seen before.

The pattern: 's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
Its matches are runs of one character class, but for three rules: a single space joins the run after it; the last
character of white space before anything else stands alone (or joins, if a space); and an apostrophe that starts a
match takes one of its endings with it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .words import _hashed

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
# fixed values: the characters that are white space in Unicode
WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_kinds: list[np.ndarray] = []


def kinds() -> np.ndarray:
    """Class of every code point."""
    if not _kinds:
        import regex

        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        table = np.full(0x110000, OTHER, np.uint8)
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
            for m in regex.finditer(pattern, every):
                table[np.frombuffer(m.group().encode("utf-32-le"), np.uint32)] = kind
        table[WHITE] = SPACE
        _kinds.append(table)
    return _kinds[0]


def split(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte spans of the pieces, in order; document d has first[d]:first[d+1]."""
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    n = len(points)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    place = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))  # byte of each code point
    edge = np.zeros(n + 1, bool)
    edge[np.searchsorted(place, offsets)] = True
    kind = kinds()[points]
    start = np.empty(n, bool)
    start[0] = True
    start[1:] = (kind[1:] != kind[:-1]) | edge[1:-1]
    # white space before something else in the same document
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~edge[1:-1])
    start[last] = True
    joins = points[last] == 0x20
    start[last[joins] + 1] = False
    # apostrophes: a run of one, at the start of a match, before letters
    mark = np.flatnonzero(start[:-1] & (points[:-1] == 0x27) & (kind[1:] == LETTER) & ~edge[1:-1])
    if len(mark):
        ahead = lambda k: np.where((mark + k < n) & ~edge[np.minimum(mark + k, n)], points[np.minimum(mark + k, n - 1)], 0)
        a, b = ahead(1), ahead(2)
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        start[mark[one | two] + 1] = False
        for m, k in ((mark[one], 2), (mark[two & ~one], 3)):
            start[m[m + k < n] + k] = True
    starts = place[:-1][start]
    ends = np.append(starts[1:], len(data))
    return starts, ends, np.searchsorted(starts, offsets)


def flat(begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(indices of the concatenated ranges begin:begin+size, first of each range and their total)."""
    total = np.append(0, np.cumsum(size))
    return np.repeat(begin - total[:-1], size) + np.arange(total[-1]), total


class Pieces:
    """Ids of pieces seen before, found by a 64-bit hash and confirmed by their bytes.

    Holds about `limit` bytes at most and starts anew beyond that. A piece whose bytes differ from those held under its
    hash is encoded on its own.
    """

    def __init__(self, encode: Callable[[list[bytes]], list[np.ndarray]], limit: int = 96 << 20):
        self.encode, self.limit = encode, limit
        self._clear()

    def _clear(self) -> None:
        none = np.empty(0, np.int64)
        self.keys, self.at, self.size, self.raw_at, self.raw_size = np.empty(0, np.uint64), none, none, none, none
        self.pool, self.raw = np.empty(0, np.uint32), np.empty(0, np.uint8)

    def held(self) -> int:
        return 40 * len(self.keys) + 4 * len(self.pool) + len(self.raw)

    def _new(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Puts pieces in whose hashes (ascending) are not held."""
        raw = data.tobytes()
        got = self.encode([raw[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)])
        size = np.fromiter(map(len, got), np.int64, len(got))
        here = np.searchsorted(self.keys, keys)
        put = lambda old, new: np.insert(old, here, new)
        self.at, self.size = put(self.at, len(self.pool) + np.cumsum(size) - size), put(self.size, size)
        long = ends - starts
        self.raw_at, self.raw_size = put(self.raw_at, len(self.raw) + np.cumsum(long) - long), put(self.raw_size, long)
        self.keys = put(self.keys, keys)
        self.pool = np.concatenate([self.pool, *got]).astype(np.uint32, copy=False)
        self.raw = np.concatenate([self.raw, data[flat(starts, long)[0]]])

    def _differ(self, row: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Pieces whose bytes are not those held in their row, a portion at a time."""
        out = [np.empty(0, np.int64)]
        for at in range(0, len(row), 1 << 16):
            r, s, e = row[at : at + (1 << 16)], starts[at : at + (1 << 16)], ends[at : at + (1 << 16)]
            long = np.minimum(e - s, self.raw_size[r])
            mine, total = flat(s, long)
            wrong = data[mine] != self.raw[mine + np.repeat(self.raw_at[r] - s, long)]
            bad = e - s != self.raw_size[r]
            if wrong.any():
                bad[np.searchsorted(total, np.flatnonzero(wrong), "right") - 1] = True
            out.append(at + np.flatnonzero(bad))
        return np.concatenate(out)

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, first id of each text)."""
        starts, ends, first = split(data, offsets)
        hashes = _hashed(data, starts, ends)
        keys, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if self.held() > self.limit:
            self._clear()
        new = np.flatnonzero(~np.isin(keys, self.keys, assume_unique=True))
        if len(new):
            self._new(keys[new], data, starts[where[new]], ends[where[new]])
        row = np.searchsorted(self.keys, keys)[inverse]
        at, size, pool = self.at[row], self.size[row], self.pool
        odd = self._differ(row, data, starts, ends)
        if len(odd):
            got = self.encode([data[starts[o] : ends[o]].tobytes() for o in odd])
            at[odd] = len(pool) + np.cumsum([0, *map(len, got)])[:-1]
            size[odd] = [len(g) for g in got]
            pool = np.concatenate([pool, *got]).astype(np.uint32, copy=False)
        place, total = flat(at, size)
        return pool[place], total[first]
