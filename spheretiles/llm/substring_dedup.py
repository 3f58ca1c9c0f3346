"""Substring dedup: Rabin-Karp hashes of every window of `width` words, counted in Spark.

1. A map over whole texts hashes every window. Neighbouring windows that share a minimizer (the smallest hash
   of an 8-word run inside them) make one row: equal windows have equal minimizers, so one key sees all their
   copies, and the hashes travel packed, 8 bytes each. Before the shuffle, windows that repeat within the map
   batch are combined to one flagged copy, and their own removal intervals are already known; so a passage that
   a third of all documents share sends one row a batch.
   A pass before it counts the windows of every slot of keys. A key in a slot of many windows (one line that many
   documents share, with different text around it) is dealt by some bits of the window's hash as well: equal windows
   still meet, and no group grows with the line's copies.
2. Each group's windows are counted; a window seen twice, or flagged, gives a removal interval.
3. A document's intervals are merged and joined to its text by document key.

Windows are compared under one key only, so two different ones count as equal only if they share their minimizer (the
64-bit hash of an 8-word run) and 63 more bits of their own hash: unrelated windows practically never, and of windows that
do share 8 words a pair in 2**63. Rows are known by a 64-bit hash of id and text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import documents, row_key, whole_groups
from .words import mix, owner, pieces, rolling, utf8, words

WINDOW_BASE = 0xC2B2AE3D27D4EB4F
GRAM, GRAM_BASE = 8, 0x9FB21C651E98DF25
SLOTS, MOST = 1 << 16, 1 << 18  # slots of keys; windows in a slot above which its keys are dealt in parts
RUNS = "key long, doc long, start int, hashes binary, places binary, span_end int"
SPANS = "doc long, start int, span_end int"


def _runs_of(keep: np.ndarray, *same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end of maximal runs of neighbours that are kept and equal in every array of `same`."""
    at = np.flatnonzero(keep)
    if not len(at):
        return at, at
    new = np.ones(len(at), bool)
    new[1:] = at[1:] != at[:-1] + 1
    for x in same:
        new[1:] |= x[at[1:]] != x[at[:-1]]
    first = np.flatnonzero(new)
    return at[first], at[np.append(first[1:], len(at)) - 1] + 1


def _slot(key: np.ndarray) -> np.ndarray:
    return (mix(key) >> np.uint64(48)).astype(np.int64)  # keys are minimal hashes: their own high bits are mostly zero


def _packed(values: np.ndarray, begin: np.ndarray, total: int) -> pa.Array:
    """Binary array of the slices of `values` that begin at `begin` (the last ends at `total`)."""
    place = np.append(begin, total).astype(np.int32) * values.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(place.tobytes()), pa.py_buffer(values.tobytes())])


def windows(batch: pa.RecordBatch, width: int, parts: np.ndarray | None = None) -> pa.RecordBatch:
    """Rows of RUNS for one slice of documents (doc, text); keys of slot s are dealt in parts[s] parts (a power of two)."""
    data, offsets = utf8(batch.column("text"))
    hashes, _, _, first = words(data, offsets)
    doc = owner(first)
    n = len(hashes) - width + 1
    if n <= 0:
        return pa.RecordBatch.from_pylist([], schema=_RUN_SCHEMA)
    inside = doc[:n] == doc[width - 1 :]
    full = rolling(hashes, width, WINDOW_BASE)
    gram = min(GRAM, width)
    least = rolling(hashes, gram, GRAM_BASE)
    span, have = width - gram + 1, 1  # smallest of `span` neighbours by doubling
    while have < span:
        step = min(have, span - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    least = least[:n]
    # combine before the shuffle: of equal windows in this slice one goes on, with the lowest bit set
    at = np.flatnonzero(inside)
    order = at[np.argsort(full[at], kind="stable")]
    sorted_full = full[order]
    new = np.ones(len(order), bool)
    new[1:] = (sorted_full[1:] | np.uint64(1)) != (sorted_full[:-1] | np.uint64(1))
    starts = np.flatnonzero(new)
    counts = np.diff(np.append(starts, len(order)))
    repeated = np.zeros(n, bool)
    repeated[order] = np.repeat(counts > 1, counts)
    sent = np.zeros(n, bool)
    sent[order[starts]] = True
    packed = (full & ~np.uint64(1)) | repeated.astype(np.uint64)
    begin, end = _runs_of(sent, doc[:n], least)
    ids = batch.column("doc").to_numpy()
    local = np.arange(n) - first[doc[:n]]
    split = np.ones(len(begin), np.int64) if parts is None else parts[_slot(least[begin])]
    whole = split == 1
    in_whole = np.zeros(n + 1, np.int64)
    np.add.at(in_whole, begin[whole], 1)
    np.add.at(in_whole, end[whole], -1)
    in_whole = np.cumsum(in_whole)[:n] > 0
    chosen = np.flatnonzero(sent & in_whole)
    blobs = _packed(packed[chosen], np.searchsorted(chosen, begin[whole]), len(chosen))
    # the runs of hot keys: one row for each part, with the places of its windows in the run
    hot = np.flatnonzero(~whole)
    long = (end - begin)[hot]
    run = np.repeat(hot, long)
    at = begin[run] + np.arange(len(run)) - np.repeat(np.cumsum(long) - long, long)
    part = (mix(full[at] | np.uint64(1)) & (split[run] - 1).astype(np.uint64)).astype(np.int64)
    by = np.lexsort((at, part, run))
    run, at, part = run[by], at[by], part[by]
    new = np.ones(len(run), bool)
    new[1:] = (run[1:] != run[:-1]) | (part[1:] != part[:-1])
    row = np.flatnonzero(new)
    hot_key = mix(least[begin[run[row]]] + mix(part[row].astype(np.uint64) + np.uint64(1)))
    blobs = pa.concat_arrays([blobs, _packed(packed[at], row, len(at))])
    places = pa.concat_arrays([pa.nulls(int(whole.sum()), pa.binary()), _packed((at - begin[run]).astype(np.int32), row, len(at))])
    key = np.concatenate([least[begin[whole]], hot_key])
    begin = np.concatenate([begin[whole], begin[run[row]]])
    s_begin, s_end = _runs_of(repeated & inside, doc[:n])
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate([key, mix(ids[doc[s_begin]].view(np.uint64) + s_begin.astype(np.uint64))]).view(np.int64)),
            pa.array(np.concatenate([ids[doc[begin]], ids[doc[s_begin]]])),
            pa.array(np.concatenate([local[begin], local[s_begin]]).astype(np.int32)),
            pa.concat_arrays([blobs, pa.nulls(len(s_begin), pa.binary())]),
            pa.concat_arrays([places, pa.nulls(len(s_begin), pa.binary())]),
            pa.array(np.concatenate([np.zeros(len(begin), np.int64), local[s_begin] + (s_end - s_begin) + width - 1]).astype(np.int32)),
        ],
        schema=_RUN_SCHEMA,
    )


_RUN_SCHEMA = pa.schema([("key", pa.int64()), ("doc", pa.int64()), ("start", pa.int32()), ("hashes", pa.binary()), ("places", pa.binary()), ("span_end", pa.int32())])
_SPAN_SCHEMA = pa.schema([("doc", pa.int64()), ("start", pa.int32()), ("span_end", pa.int32())])


def _joined(column: pa.ChunkedArray) -> bytes:
    """The bytes of a binary column, one value after the other (nulls have none)."""
    return b"".join(c.buffers()[2][np.frombuffer(c.buffers()[1], np.int32)[c.offset] : np.frombuffer(c.buffers()[1], np.int32)[c.offset + len(c)]] for c in column.chunks if len(c) and c.buffers()[2] is not None)


def _counted(table: pa.Table, width: int) -> pa.RecordBatch:
    """Removal intervals of the windows of whole keys."""
    known = table.filter(pa.compute.is_null(table.column("hashes"))).select(["doc", "start", "span_end"])
    runs = table.filter(pa.compute.is_valid(table.column("hashes")))
    size = pa.compute.binary_length(runs.column("hashes")).to_numpy().astype(np.int64) // 8
    values = np.frombuffer(_joined(runs.column("hashes")), np.uint64)
    row = np.repeat(np.arange(runs.num_rows), size)
    body = values >> np.uint64(1)
    order = np.argsort(body, kind="stable")
    ordered = body[order]
    new = np.ones(len(order), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    starts = np.flatnonzero(new)
    counts = np.diff(np.append(starts, len(order)))
    again = np.zeros(len(values), bool)
    again[order] = np.repeat(counts > 1, counts)  # flagged ones have their interval from the map
    place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    place[np.repeat(pa.compute.is_valid(runs.column("places")).to_numpy(zero_copy_only=False), size)] = np.frombuffer(_joined(runs.column("places")), np.int32)
    local = runs.column("start").to_numpy()[row] + place
    begin, end = _runs_of(again, row, local - np.arange(len(row)))
    doc = runs.column("doc").to_numpy()
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate([doc[row[begin]], known.column("doc").to_numpy()])),
            pa.array(np.concatenate([local[begin], known.column("start").to_numpy()]).astype(np.int32)),
            pa.array(np.concatenate([local[begin] + (end - begin) + width - 1, known.column("span_end").to_numpy()]).astype(np.int32)),
        ],
        schema=_SPAN_SCHEMA,
    )


def slot_parts(docs: DataFrame, width: int, most: int) -> np.ndarray:
    """Number of parts (powers of two) for the keys of each slot: about `most` windows, or eight times the mean, to a part."""

    def tally(batches):
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for part in pieces(batch):
                runs = windows(part, width)
                runs = runs.filter(pa.compute.is_valid(runs.column("hashes")))
                size = pa.compute.binary_length(runs.column("hashes")).to_numpy(zero_copy_only=False) // 8
                np.add.at(total, _slot(runs.column("key").to_numpy().view(np.uint64)), size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["slot", "n"])

    counted = docs.select("doc", "text").mapInArrow(tally, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    found = counted.toPandas()  # SLOTS rows at most
    parts = np.ones(SLOTS, np.int64)
    most = max(most, 8 * int(found["n"].sum()) // SLOTS)
    over = found[found["n"] > most]
    parts[over["slot"].to_numpy(np.int64)] = 1 << np.ceil(np.log2(over["n"].to_numpy(np.float64) / most)).astype(np.int64)
    return parts


def repeated_spans(docs: DataFrame, width: int = 35, most: int = MOST) -> DataFrame:
    """(doc, spans): merged word intervals [start, end) of documents (doc: key, text) that windows repeated anywhere cover."""
    parts = docs.sparkSession.sparkContext.broadcast(slot_parts(docs, width, most))  # SLOTS numbers, whatever the input

    def emit(batches):
        for batch in batches:
            for part in pieces(batch):
                yield windows(part, width, parts.value)

    def count(batches):
        for table in whole_groups(batches, ["key"]):
            yield _counted(table, width)

    spans = docs.select("doc", "text").mapInArrow(emit, RUNS).repartition("key").sortWithinPartitions("key").mapInArrow(count, SPANS)
    # the spans of a document that lie in one partition are merged there before they travel
    return spans.groupBy("doc").agg(F.collect_set(F.struct("start", F.col("span_end").alias("end"))).alias("spans"))


def _merged(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s in sorted((x["start"], x["end"]) for x in spans or ()):
        if out and s[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s[1])
        else:
            out.append(list(s))
    return [tuple(x) for x in out]


def substring_dedup(docs: DataFrame, width: int = 35, text: str = "text", key: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    """`docs` with the columns n_words, n_removed, kept_text and removed_spans added (all other columns stay).

    Every word covered by a window of `width` words whose word sequence also starts anywhere else is removed;
    kept words are joined by one space. Null and empty texts have no words and an empty kept text. Rows that are
    equal in `key` are copies of each other and lose all their windows. An empty table gives an empty table.
    Columns of `docs` with the names of added ones are replaced.
    """
    keyed = docs.withColumn("__llm_doc", row_key(*dict.fromkeys([*key, text])))
    spans = repeated_spans(keyed.select(F.col("__llm_doc").alias("doc"), F.col(text).alias("text")), width)
    joined = keyed.join(spans.select(F.col("doc").alias("__llm_doc"), F.col("spans").alias("__llm_spans")), "__llm_doc", "left").drop("__llm_doc")
    base = [f for f in docs.schema.fields if f.name not in ("n_words", "n_removed", "kept_text", "removed_spans")]
    names = [f.name for f in base]
    from pyspark.sql import types as T

    schema = T.StructType([*base, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType()), T.StructField("removed_spans", T.ArrayType(T.ArrayType(T.IntegerType())))])

    def cut(batches):
        for batch in batches:
            counts, removed, kept, places = [], [], [], []
            for body, spans in zip(batch.column(text).to_pylist(), batch.column("__llm_spans").to_pylist(), strict=True):
                found = (body or "").encode().split()
                merged = _merged(spans)
                counts.append(len(found))
                removed.append(sum(b - a for a, b in merged))
                for a, b in reversed(merged):
                    del found[a:b]
                kept.append(b" ".join(found).decode())
                places.append([list(x) for x in merged])
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in names], pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), pa.array(places, pa.list_(pa.list_(pa.int32())))],
                names=[*names, "n_words", "n_removed", "kept_text", "removed_spans"],
            )

    return joined.select(*names, "__llm_spans", *([] if text in names else [text])).mapInArrow(cut, schema)


def op9_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Contract query: words removed and the digest of the kept words of every document."""
    found = substring_dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
