"""LM scoring by stupid backoff: n-gram count tables dealt by hash, joined with the n-grams of documents, summed per document.

The model counts the unigrams, bigrams and trigrams of all documents. A word after words a, b scores
count(a b w) / count(a b) if that trigram occurs `least` times or more, else `backoff` * count(b w) / count(b) under the
same condition, else backoff**2 * count(w) / all words; at the start of a document shorter contexts start lower down
without a penalty. A document's score is the mean natural logarithm over its words. With `others`, as the registered query has
it, bigrams and trigrams (and the contexts they are divided by) count in the other documents alone. A document's own words would
make each of its n-grams seen, and nothing would ever back off. The last level has the words of all documents, never 0.

1. Documents are dealt into slices of about `SLICE` bytes by a hash of id and text: the only time that texts travel.
2. The n-grams of a slice are combined: each distinct one goes once, with its count there, to the bucket that the first
   bits of its hash name. A row holds all n-grams of one slice and bucket, sorted, as differences of their hashes. However
   common an n-gram is, a bucket gets it once a slice, so no key is hot.
3. A bucket adds up its counts (the count table) and answers each slice with the totals of its n-grams, in their order.
4. Slices (their shuffle is used again) meet their answers; every word finds its counts by the place of its n-grams.

N-grams are told apart by the bits of the bucket's number and `EXTRA` more, 64 at most. Buckets hold about as many n-grams at
every size of the input, so at any size up to 5e12 words about one n-gram in a million shares these bits with another and gets
both counts; beyond it, twice as many for twice the words.
"""

from __future__ import annotations

from math import ceil, log, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import documents, group_starts, whole_groups
from .words import mix, owner, pieces, utf8, words

SLICE, BUCKET, EXTRA = 4 << 20, 1 << 20, 40
LARGE = 255  # in an answer's byte for each n-gram: the total is among the large ones


class Grams:
    """The n-grams of one slice: `distinct` keys (ascending) and their `times`; words know their n-grams by `place`."""

    def __init__(self, text, bits: int):
        h, _, _, self.first = words(*utf8(text))
        self.doc = owner(self.first)
        self.at = np.arange(len(h)) - self.first[self.doc]
        self.second, self.third = np.flatnonzero(self.at >= 1), np.flatnonzero(self.at >= 2)
        step = lambda x, y: mix(x * np.uint64(0xD6E8FEB86659FD93) + y)
        two = step(h[self.second - 1], h[self.second])
        three = step(step(h[self.third - 2], h[self.third - 1]), h[self.third] ^ np.uint64(0x9E3779B97F4A7C15))
        keys = np.concatenate([mix(h ^ np.uint64(0x5851F42D4C957F2D)), two, three]) >> np.uint64(64 - bits)
        self.distinct, place, self.times = np.unique(keys, return_inverse=True, return_counts=True)
        self.place = np.split(place, [len(h), len(h) + len(two)])

    def _own(self, k: int) -> np.ndarray:
        """How often each word's n-gram of k + 1 words stands in the word's own document."""
        doc = self.doc[(slice(None), self.second, self.third)[k]]
        _, place, times = np.unique(doc * len(self.distinct) + self.place[k], return_inverse=True, return_counts=True)
        return times[place]

    def scores(self, totals: np.ndarray, words_in_all: int, least: int, backoff: float, others: bool = False) -> np.ndarray:
        """Mean logarithm of each document's word scores (NaN without words), from the totals of `distinct`."""
        n = len(self.at)
        c1, c2, c3 = totals[self.place[0]], np.zeros(n, np.int64), np.zeros(n, np.int64)
        c2[self.second], c3[self.third] = totals[self.place[1]], totals[self.place[2]]
        ln = np.log(c1 / max(1, words_in_all)) + np.minimum(self.at, 2) * log(backoff)
        if others:
            c1 = c1 - self._own(0)
            c2[self.second] -= self._own(1)
            c3[self.third] -= self._own(2)
        bi = np.flatnonzero((c2 >= least) & (self.at >= 1))
        ln[bi] = np.log(c2[bi] / c1[bi - 1]) + (self.at[bi] >= 2) * log(backoff)
        tri = np.flatnonzero((c3 >= least) & (self.at >= 2))
        ln[tri] = np.log(c3[tri] / c2[tri - 1])
        count = np.diff(self.first)
        return np.bincount(self.doc, ln, len(count)) / np.where(count > 0, count, np.nan)


def _squeezed(x: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(x).tobytes(), "zstd", asbytes=True)


def _restored(x: bytes, n: int, kind) -> np.ndarray:
    return np.frombuffer(pa.decompress(x, n * np.dtype(kind).itemsize, "zstd", asbytes=True), kind)


_SENT = pa.schema([("slice", pa.int64()), ("bucket", pa.int32()), ("n", pa.int32()), ("base", pa.int64()), ("low", pa.binary()), ("top", pa.binary()), ("times", pa.binary())])
_ANSWER = pa.schema([("slice", pa.int64()), ("bucket", pa.int32()), ("n", pa.int32()), ("small", pa.binary()), ("large", pa.binary())])


def key_bits(words_in_all: int) -> tuple[int, int]:
    """Bits of a bucket's number, and more bits that tell its n-grams apart: 64 together at most, as a hash has."""
    lead = max(6, ceil(log2(max(1, 3 * words_in_all / BUCKET))))
    return lead, min(EXTRA, 64 - lead)


def _sent(number: int, grams: Grams, extra: int) -> pa.RecordBatch:
    """A row for each bucket: its sorted n-grams as differences; their first byte is packed apart, as it is mostly small."""
    keys = grams.distinct
    bucket, rest = (keys >> np.uint64(extra)).astype(np.int32), (keys & np.uint64((1 << extra) - 1)).astype(np.int64)
    begin = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(keys) else np.empty(0, np.int64)
    gap = np.diff(rest, prepend=0)
    gap[begin] = 0
    width = max(2, -(-int(gap.max(initial=0)).bit_length() // 8))
    plain = gap.astype("<i8").view(np.uint8).reshape(-1, 8)
    low, top = plain[:, : width - 1].copy(), plain[:, width - 1].copy()
    n = np.diff(np.append(begin, len(keys)))
    part = lambda x: [_squeezed(x[b : b + k]) for b, k in zip(begin.tolist(), n.tolist(), strict=True)]
    lows = [low[b : b + k].tobytes() for b, k in zip(begin.tolist(), n.tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(n), number)), pa.array(bucket[begin]), pa.array(n.astype(np.int32)), pa.array(rest[begin]), pa.array(lows, pa.binary()), pa.array(part(top), pa.binary()), pa.array(part(grams.times.astype("<u4")), pa.binary())], schema=_SENT)


def _counted(batches):
    for table in whole_groups(batches, ["bucket"], 1):
        starts = group_starts(table, ["bucket"])
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            rows = table.slice(a, b - a)
            keys, times = [], []
            for r in rows.select(["n", "base", "low", "top", "times"]).to_pylist():
                n = r["n"]
                gap = np.zeros((n, 8), np.uint8)
                width = len(r["low"]) // n + 1
                gap[:, : width - 1] = np.frombuffer(r["low"], np.uint8).reshape(n, -1)
                gap[:, width - 1] = _restored(r["top"], n, np.uint8)
                keys.append(r["base"] + np.cumsum(gap.view("<i8")[:, 0]))
                times.append(_restored(r["times"], n, "<u4"))
            _, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            totals = np.bincount(inverse, np.concatenate(times)).astype(np.int64)[inverse]
            parts = np.split(totals, np.cumsum([len(k) for k in keys])[:-1])
            small = [_squeezed(np.minimum(p, LARGE).astype(np.uint8)) for p in parts]
            large = [p[p >= LARGE].astype("<i8").tobytes() for p in parts]
            yield pa.RecordBatch.from_arrays([*[rows.column(c).combine_chunks() for c in ("slice", "bucket", "n")], pa.array(small, pa.binary()), pa.array(large, pa.binary())], schema=_ANSWER)


def _totals(answers: pa.Table) -> np.ndarray:
    rows = answers.sort_by("bucket").select(["n", "small", "large"]).to_pylist()
    if not rows:
        return np.empty(0, np.int64)
    out = np.concatenate([_restored(r["small"], r["n"], np.uint8) for r in rows]).astype(np.int64)
    out[out == LARGE] = np.frombuffer(b"".join(r["large"] for r in rows), "<i8")
    return out


def _size(docs: DataFrame) -> tuple[int, int]:
    """Bytes and words of all texts."""

    def tally(batches):
        size = n = 0
        for batch in batches:
            for part in pieces(batch):
                data, offsets = utf8(part.column("text"))
                size, n = size + len(data), n + len(words(data, offsets)[0])
        yield pa.RecordBatch.from_arrays([pa.array([size]), pa.array([n])], ["size", "n"])

    size, n = docs.select("text").mapInArrow(tally, "size long, n long").agg(F.sum("size"), F.sum("n")).first()
    return size or 0, n or 0


def lm_scores(docs: DataFrame, id: str = "doc_id", text: str = "text", least: int = 1, backoff: float = 0.4, others: bool = False) -> DataFrame:
    """(id, n_words, lm_score) of every row: the mean logarithm of its words' scores under counts of all rows; with `others`, of
    all rows but itself (its words of the last level counted in all).

    Words are maximal runs of anything but space and the five ASCII white-space controls. A null or empty text, or one
    of white space alone, has 0 words and a null score. Repeated rows count each time and have equal scores; a null id
    stays null; an empty table gives an empty result. Other columns are not read. Rows equal in id and text are in one
    slice together.
    """
    own = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    size, total = _size(own)
    lead, extra = key_bits(total)
    sliced = own.withColumn("slice", F.pmod(F.xxhash64("id", "text"), F.lit(max(1, -(-size // SLICE)))).cast("long")).repartition("slice")

    def send(batches):
        for table in whole_groups(batches, ["slice"], 1):
            number, starts = table.column("slice").to_numpy(), group_starts(table, ["slice"])
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                yield _sent(int(number[a]), Grams(table.slice(a, b - a).column("text"), lead + extra), extra)

    def finish(mine: pa.Table, answers: pa.Table) -> pa.Table:
        grams, totals = Grams(mine.column("text"), lead + extra), _totals(answers)
        if len(totals) != len(grams.distinct):
            raise ValueError("a slice differs from what it sent: the input must be a table or a checkpoint")
        score = grams.scores(totals, total, least, backoff, others)
        return pa.table([mine.column("id"), pa.array(np.diff(grams.first).astype(np.int64)), pa.array(score, mask=np.isnan(score))], names=["id", "n_words", "lm_score"])

    sent = sliced.sortWithinPartitions("slice").mapInArrow(send, "slice long, bucket int, n int, base long, low binary, top binary, times binary")
    answers = sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_counted, "slice long, bucket int, n int, small binary, large binary")
    schema = T.StructType([T.StructField("id", own.schema["id"].dataType), T.StructField("n_words", T.LongType()), T.StructField("lm_score", T.DoubleType())])
    return sliced.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(finish, schema).withColumnRenamed("id", id)


def op7_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """Every document's number of words and mean log score under the other documents, rounded to six places."""
    return lm_scores(documents(spark, sf_dir), others=True).withColumn("lm_score", F.round("lm_score", 6) + 0.0)


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM w),
g AS (SELECT doc_id, i, w, lag(w) OVER d AS b, lag(w, 2) OVER d AS a FROM p WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
c3 AS (SELECT *, sum(own) OVER (PARTITION BY a, b, w) - own AS n FROM (SELECT doc_id, a, b, w, count(*) AS own FROM g WHERE a IS NOT NULL GROUP BY ALL)),
c2 AS (SELECT *, sum(own) OVER (PARTITION BY b, w) - own AS n FROM (SELECT doc_id, b, w, count(*) AS own FROM g WHERE b IS NOT NULL GROUP BY ALL)),
c1 AS (SELECT *, sum(own) OVER (PARTITION BY w) - own AS n FROM (SELECT doc_id, w, count(*) AS own FROM g GROUP BY ALL)),
s AS (SELECT g.doc_id, CASE WHEN c3.n >= 1 THEN ln(c3.n / h2.n)
  WHEN c2.n >= 1 THEN ln(c2.n / h1.n) + CASE WHEN g.a IS NULL THEN 0 ELSE ln(0.4) END
  ELSE ln((c1.n + c1.own) / (SELECT sum(own) FROM c1)) + CASE WHEN g.b IS NULL THEN 0 WHEN g.a IS NULL THEN ln(0.4) ELSE 2 * ln(0.4) END END AS l
 FROM g JOIN c1 ON c1.doc_id = g.doc_id AND c1.w = g.w LEFT JOIN c3 ON c3.doc_id = g.doc_id AND c3.a = g.a AND c3.b = g.b AND c3.w = g.w
 LEFT JOIN c2 ON c2.doc_id = g.doc_id AND c2.b = g.b AND c2.w = g.w LEFT JOIN c2 h2 ON h2.doc_id = g.doc_id AND h2.b = g.a AND h2.w = g.b
 LEFT JOIN c1 h1 ON h1.doc_id = g.doc_id AND h1.w = g.b),
m AS (SELECT doc_id, avg(l) AS l FROM s GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, round(m.l, 6) + 0.0 AS lm_score FROM w LEFT JOIN m USING (doc_id)
"""
