"""Byte-level BPE by prefix dynamic programming.

For every byte prefix of a piece there is one valid last token; storing it for each prefix makes the encoding of any
prefix a walk back from its end, lets bytes be appended without touching what was stored, and after an edit only the
prefixes from it on are computed again, up to where they agree with the stored ones. A token may follow another exactly if merging their bytes in rank order never
joins across the boundary, which is read off the two chains of tokens that touch the boundary while merging.

Whole-piece tokens come first, as in the public encoders. Ranks must rise with merging (a token's rank is above those
of its two parts), which loading checks. Encoding works on many pieces at once, one prefix length at a time.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pretokens import Pieces
from .tables import documents
from .words import _BYTE_BASE, mix, pieces, powers, utf8

NONE = np.uint32(0xFFFFFFFF)
MEMO = 20  # bits of the table of pairs tried before


def merged(piece: bytes, ranks: dict[bytes, int], below: int = 1 << 62) -> list[bytes]:
    """Plain BPE of a short piece with the merges below a rank; used once per vocabulary entry when loading."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, i = min((ranks.get(parts[i] + parts[i + 1], 1 << 62), i) for i in range(len(parts) - 1))
        if rank >= below or rank == 1 << 62:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Bytes:
    """The bytes of every id, one after another: all that decoding needs."""

    def __init__(self, ranks: dict[bytes, int]):
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, r in ranks.items():
            self.tokens[r] = token
        self.size = np.array([len(t) for t in self.tokens], np.int64)
        self.pool = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.at = np.cumsum(self.size) - self.size

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of all ids, one after another."""
        size = self.size[ids]
        begin = np.cumsum(size) - size
        return self.pool[np.repeat(self.at[ids] - begin, size) + np.arange(size.sum())]


class Vocabulary(Bytes):
    def __init__(self, ranks: dict[bytes, int]):
        super().__init__(ranks)
        n = len(self.tokens)
        self.ranks = ranks
        left, right = np.full(n, NONE), np.full(n, NONE)
        self.reachable = np.zeros(n, bool)
        pairs: dict[int, int] = {}
        for token, r in ranks.items():
            if len(token) == 1:
                self.reachable[r] = True
                continue
            parts = merged(token, ranks, r)
            if len(parts) == 2:
                left[r], right[r] = ranks[parts[0]], ranks[parts[1]]
                if max(left[r], right[r]) >= r:
                    raise ValueError("a token has a lower rank than its parts")
                self.reachable[r] = True
        for token, r in ranks.items():  # any split of a token is a pair that merges to it
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a * n + b] = r
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_rank = np.array([pairs[k] for k in self.pair_keys.tolist()], np.uint32)
        del pairs
        self.first_chain, self.last_chain = self._chains(left), self._chains(right)
        self.longest = max(map(len, ranks))
        size, flat = self.size, self.pool
        usable = np.flatnonzero(size > 0)
        total = np.append(np.uint64(0), np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * powers(_BYTE_BASE, len(flat))))
        begin = self.at[usable]
        h = mix((total[begin + size[usable]] - total[begin]) * powers(_BYTE_BASE, len(flat), inverse=True)[begin] + size[usable].astype(np.uint64))
        order = np.argsort(h)
        self.hash, self.hash_id = h[order], usable[order].astype(np.uint32)
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[(h >> np.uint64(42)).astype(np.int64)] = True
        self.memo_pair = np.full(1 << MEMO, -1, np.int64)
        self.memo_ok = np.zeros(1 << MEMO, bool)

    def _chains(self, part: np.ndarray) -> np.ndarray:
        """For each token the tokens at one edge while it is merged, from its byte to itself, then NONE."""
        chains = []
        for t in range(len(part)):
            c = [t]
            while part[c[-1]] != NONE:
                c.append(int(part[c[-1]]))
            chains.append(c[::-1])
        out = np.full((len(part), max(map(len, chains)) + 1), NONE, np.uint32)
        for t, c in enumerate(chains):
            out[t, : len(c)] = c
        return out

    def _pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) * len(self.tokens) + b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_rank[at], NONE)

    def _follows(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        ok = np.zeros(len(a), bool)
        at = np.arange(len(a))
        x, y = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
        while len(at):
            s, t = a[at], b[at]
            rank = self._pair(self.last_chain[s, x], self.first_chain[t, y])
            up, down = self.last_chain[s, x + 1], self.first_chain[t, y + 1]
            joined = (rank < up) & (rank <= down) & (rank != NONE)
            done = (up == NONE) & (down == NONE) & ~joined
            ok[at[done]] = True
            go = ~joined & ~done
            left = up <= down
            at, x, y = at[go], (x + left)[go], (y + ~left)[go]
        return ok

    def follows(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether token b may follow token a."""
        key = a.astype(np.int64) * len(self.tokens) + b
        slot = (mix(key.view(np.uint64)) >> np.uint64(64 - MEMO)).astype(np.int64)
        ok = self.memo_ok[slot]
        miss = np.flatnonzero(self.memo_pair[slot] != key)
        if len(miss):
            keys, where, inverse = np.unique(key[miss], return_index=True, return_inverse=True)
            got = self._follows(a[miss][where], b[miss][where])
            ok[miss] = got[inverse]
            s = slot[miss][where]
            self.memo_pair[s], self.memo_ok[s] = keys, got
            later = np.flatnonzero(self.memo_pair[s] != keys)  # two keys in one slot: the later one stays
            self.memo_ok[s[later]] = self.memo_ok[s[later]] & False
            self.memo_pair[s[later]] = -1
        return ok

    def _found(self, data: np.ndarray, begin: np.ndarray, size, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of data[begin:begin+size] (hashes h) are tokens that merging can reach, and the tokens; bytes are compared."""
        hit = np.flatnonzero(self.maybe[(h >> np.uint64(42)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hash, h[hit]), len(self.hash) - 1)
        token = self.hash_id[at]
        real = np.flatnonzero((self.hash[at] == h[hit]) & self.reachable[token])
        hit, token = hit[real], token[real]
        long = size[hit] if isinstance(size, np.ndarray) else np.full(len(hit), size)
        real = self.size[token] == long
        hit, token, long = hit[real], token[real], long[real]
        row = np.repeat(np.arange(len(hit)), long)
        step = np.arange(len(row)) - np.repeat(np.cumsum(long) - long, long)
        wrong = data[begin[hit][row] + step] != self.pool[self.at[token][row] + step]
        if wrong.any():
            real = np.bincount(row, wrong, len(hit)) == 0
            hit, token = hit[real], token[real]
        return hit, token

    def last_tokens(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray, kept: np.ndarray | None = None) -> np.ndarray:
        """The valid last token of every non-empty prefix, in the layout of data; pieces are data[begin:begin+size].

        kept: last tokens stored before, NONE where unknown (they are not computed again).
        """
        last = np.full(len(data), NONE, np.uint32) if kept is None else kept.copy()
        total = np.append(np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_BYTE_BASE, len(data))))
        inverse = powers(_BYTE_BASE, len(data) + 1, inverse=True)
        order = np.argsort(-size, kind="stable")
        begin, size = begin[order], size[order]
        for i in range(1, int(size[0]) + 1 if len(size) else 1):
            b = begin[: np.searchsorted(-size, -i, "right")]
            b = b[last[b + i - 1] == NONE]
            if 0 < len(b) <= 64:  # few (long) pieces are left: all token lengths at once
                n = np.tile(np.arange(1, min(i, self.longest) + 1), len(b))
                e = np.repeat(b + i, min(i, self.longest))
                hit, token = self._found(data, e - n, n, mix((total[e] - total[e - n]) * inverse[e - n] + n.astype(np.uint64)))
                n, e = n[hit], e[hit]
                before = np.where(n < i, last[np.maximum(e - n, 1) - 1], 0)
                ok = np.flatnonzero(n == i)
                check = np.flatnonzero((n < i) & (before != NONE))
                ok = np.append(ok, check[self.follows(before[check], token[check])])
                last[e[ok] - 1] = token[ok]
                continue
            for n in range(min(i, self.longest), 0, -1):
                s = b + i - n
                hit, token = self._found(data, s, n, mix((total[s + n] - total[s]) * inverse[s] + np.uint64(n)))
                if not len(hit):
                    continue
                if n < i:
                    before = last[s[hit] - 1]
                    real = before != NONE
                    hit, token, before = hit[real], token[real], before[real]
                    real = self.follows(before, token)
                    hit, token = hit[real], token[real]
                last[b[hit] + i - 1] = token
                rest = np.ones(len(b), bool)
                rest[hit] = False
                b = b[rest]
                if not len(b):
                    break
        return last

    def walk(self, last: np.ndarray, begin: int, end: int) -> list[int]:
        """Ids of the prefix that ends at `end`."""
        out = []
        while end > begin:
            out.append(int(last[end - 1]))
            end -= int(self.size[out[-1]])
        return out[::-1]

    def encode_pieces(self, raw: list[bytes]) -> list[np.ndarray]:
        whole = [self.ranks.get(p) for p in raw]
        rest = [i for i, w in enumerate(whole) if w is None]
        out: list = [None if w is None else np.array([w], np.uint32) for w in whole]
        for at in range(0, len(rest), 200_000):
            mine = rest[at : at + 200_000]
            size = np.array([len(raw[i]) for i in mine], np.int64)
            begin = np.cumsum(size) - size
            last = self.last_tokens(np.frombuffer(b"".join(raw[i] for i in mine), np.uint8), begin, size)
            # all walks at once, from the ends
            end, row = begin + size, np.arange(len(mine))
            ids, rows = [], []
            while len(row):
                token = last[end - 1]
                ids.append(token)
                rows.append(row)
                end = end - self.size[token]
                go = end > begin[row]
                end, row = end[go], row[go]
            if ids:
                ids, rows = np.concatenate(ids), np.concatenate(rows)
                step = np.arange(len(ids))
                order = np.lexsort((-step, rows))
                ids = ids[order]
                cut = np.cumsum(np.bincount(rows, minlength=len(mine)))
                for i, part in zip(mine, np.split(ids, cut[:-1]), strict=True):
                    out[i] = part
        return out


class PrefixEncoding:
    """One piece with its stored last tokens: exact appends, and edits that recompute only what they change.

    The last token of a prefix depends on the `longest` bytes before its end and on the last tokens stored there. So
    after an edit, prefixes are computed from its begin until `longest` stored ones in a row agree; the rest stays.
    `computed` counts the prefixes that the latest call computed.
    """

    def __init__(self, vocabulary: Vocabulary, piece: bytes = b""):
        self.vocabulary, self.piece, self.last, self.computed = vocabulary, b"", [], 0
        self.append(piece)

    def append(self, more: bytes) -> None:
        self.edit(len(self.piece), len(self.piece), more)

    def _last(self, i: int) -> int:
        """The last token of the first i bytes, from what is stored for shorter prefixes; -1 if there is none."""
        v = self.vocabulary
        for n in range(min(i, v.longest), 0, -1):
            token = v.ranks.get(self.piece[i - n : i])
            if token is None or not v.reachable[token]:
                continue
            if n == i:
                return token
            before = self.last[i - n - 1]
            if before >= 0 and v.follows(np.array([before]), np.array([token]))[0]:
                return token
        return -1

    def edit(self, begin: int, end: int, new: bytes) -> None:
        """piece[begin:end] becomes `new`."""
        old, longest = self.last, self.vocabulary.longest
        self.piece = self.piece[:begin] + new + self.piece[end:]
        shift = len(new) - (end - begin)
        self.last, agreed, self.computed = old[:begin], 0, 0
        for i in range(begin + 1, len(self.piece) + 1):
            self.last.append(self._last(i))
            self.computed += 1
            at = i - shift  # the stored prefix that ends at the same byte
            agreed = agreed + 1 if i > begin + len(new) and at > end and old[at - 1] == self.last[-1] else 0
            if agreed >= longest:
                self.last += old[at:]
                return

    def ids(self) -> list[int]:
        whole = self.vocabulary.ranks.get(self.piece)
        return [whole] if whole is not None else self.vocabulary.walk(self.last, 0, len(self.piece))


_loaded: dict[str, tuple[Vocabulary, Pieces]] = {}
_bytes: dict[str, Bytes] = {}


def loaded(path: str) -> tuple[Vocabulary, Pieces]:
    """The vocabulary and the pieces seen so far in this worker."""
    if path not in _loaded:
        vocabulary = Vocabulary(read_ranks(path))
        _loaded[path] = vocabulary, Pieces(vocabulary.encode_pieces)
    return _loaded[path]


def loaded_bytes(path: str) -> Bytes:
    if path not in _bytes:
        _bytes[path] = Bytes(read_ranks(path))
    return _bytes[path]


def _binary(values: np.ndarray, first: np.ndarray) -> pa.Array:
    width = values.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(first) - 1, [None, pa.py_buffer((first * width).astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def _decoded(table: Bytes, ids: np.ndarray, first: np.ndarray) -> pa.Array:
    """Bytes of the ids of each row; row r has ids[first[r]:first[r + 1]]."""
    return _binary(table.decode(ids), np.append(0, np.cumsum(table.size[ids]))[first])


def encode(docs: DataFrame, path: str, text: str = "text", id: str = "doc_id", decoded: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids[, decoded]): ids as little-endian unsigned 32-bit integers in a binary column, in the
    input's order; with `decoded` the bytes that the ids stand for, in the same pass over the texts.

    path: rank file of a public tokenizer, present on every executor. Null and empty texts have no ids. Null or
    repeated doc_ids stay as they are, one row for each input row. Other columns are not read.
    """

    def run(batches):
        for batch in batches:
            for part in pieces(batch):
                vocabulary, seen = loaded(path)
                ids, first = seen.ids(*utf8(part.column("text")))
                columns = [part.column("doc_id"), pa.array(np.diff(first)), _binary(ids.astype("<u4"), first)]
                if decoded:
                    columns.append(_decoded(vocabulary, ids, first))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids", *["decoded"] * decoded])

    return docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids binary" + ", decoded binary" * decoded)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """`encoded` (doc_id, n_tokens, ids) with the column decoded: the bytes of the ids. Null ids give null."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "ids"):
                column = part.column("ids")
                raw, first = utf8(column)
                out = _decoded(loaded_bytes(path), np.frombuffer(raw.tobytes(), "<u4"), first // 4)
                if column.null_count:
                    out = pa.compute.if_else(column.is_valid(), out, pa.scalar(None, pa.binary()))
                yield pa.RecordBatch.from_arrays([*part.columns, out], [*part.schema.names, "decoded"])

    return encoded.mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded binary")


def op4_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Contract query: digests of the ids of every document and of the bytes they decode to."""
    import public_tokenizers

    both = encode(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), decoded=True)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
