"""MinHash near-dedup with tensored banding.

Two collections of `side` sub-signatures (`depth` minhashes each) give side * side tables: table (i, j) is keyed by
sub-signature i of the first and j of the second collection. So 2 * side * depth minhashes serve side**2 tables of
2 * depth hashes each, about a square root of what plain banding computes. A pair of similarity s shares a table with
probability (1 - (1 - s**depth)**side)**2: 0.99985 at s = 0.85 with the defaults, and nearer to 1 above.

Documents with equal shingle sets are one class, found by a 128-bit hash of the set; the rest works on class
representatives. Candidates are settled in three steps, each confirmed on full sets:
1. every member of a bucket against the smallest member (as many pairs as members),
2. in buckets whose members are still in different components: pairs between components whose signatures agree enough
   (at least the share `agree` of the minhashes; a pair at the threshold falls below it about once in a million),
3. the same within blocks of large buckets, inside tasks that hold the sets of two blocks and return confirmed links.
No bucket or candidate list is cut off.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import arrow_sorted, components, documents, group_starts, pairs_in_groups, whole_groups, written
from .words import mix, pieces, shingles, utf8

SIDE, DEPTH = 10, 3
BLOCK = 1024
EMIT = 8192  # classes to a task that emits their keys, side * side each


def _multipliers(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def signatures(values: np.ndarray, first: np.ndarray, n_hashes: int) -> np.ndarray:
    """Low 16 bits of the minhashes of each (non-empty) set."""
    starts = first[:-1]
    out = np.empty((len(starts), n_hashes), np.uint16)
    for k, m in enumerate(_multipliers(n_hashes)):
        out[:, k] = np.minimum.reduceat((values * m) >> np.uint64(32), starts) & np.uint64(0xFFFF)
    return out


def features(docs: DataFrame, width: int, n_hashes: int) -> DataFrame:
    """(id, n, h1, h2, sig): set size, 128-bit hash of the set, signature (null for an empty set)."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch):
                values, first = shingles(*utf8(part.column("text")), width)
                n = np.diff(first)
                full = np.flatnonzero(n)
                h1, h2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
                sig = np.zeros((len(n), n_hashes), np.uint16)
                if len(full):
                    starts = first[:-1][full]
                    h1[full] = np.add.reduceat(mix(values + np.uint64(0x1234567)), starts)
                    h2[full] = np.add.reduceat(mix(values ^ np.uint64(0x5DEECE66D1234567)), starts)
                    sig[full] = signatures(values, np.append(starts, len(values)), n_hashes)
                rows = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * n_hashes), len(n), [None, pa.py_buffer(sig.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(n.astype(np.int64)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), rows], ["id", "n", "h1", "h2", "sig"])

    return docs.select("id", "text").mapInArrow(run, "id long, n long, h1 long, h2 long, sig binary")


def _matrix(column, n_hashes: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, n_hashes)


def table_keys(sig: np.ndarray, side: int, depth: int) -> np.ndarray:
    """One key for each document and table."""
    part = np.zeros((len(sig), 2 * side), np.uint64)
    for j in range(depth):
        part = part * np.uint64(1 << 16) + sig[:, j::depth].astype(np.uint64)
    a, b = mix(part[:, :side] + np.arange(1, side + 1, dtype=np.uint64) * np.uint64(1 << 52)), mix(part[:, side:] + np.arange(101, side + 101, dtype=np.uint64) * np.uint64(1 << 52))
    return mix(a[:, :, None] * np.uint64(3) + b[:, None, :]).reshape(len(sig), -1)


def _first_table(x: np.ndarray, y: np.ndarray, side: int, depth: int) -> np.ndarray:
    """Number of the first table that two signatures share (they share one at least)."""
    same = (x == y).reshape(len(x), 2 * side, depth).all(axis=2)
    return same[:, :side].argmax(axis=1) * side + same[:, side:].argmax(axis=1)


def _emit_keys(side: int, depth: int):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                keys = table_keys(_matrix(batch.column("sig"), 2 * side * depth), side, depth)
                rep = np.repeat(batch.column("rep").to_numpy(), side * side)
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.tile(np.arange(side * side, dtype=np.int32), len(keys))), pa.array(rep)], ["key", "tab", "rep"])

    return run


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    left = sets.select(F.col("id").alias("a"), F.col("items").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("items").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return pairs.join(left, "a").join(right, "b").where(100 * both >= percent * (F.size("x") + F.size("y") - both)).select("a", "b")


def _close_pairs(side: int, depth: int, agree: int):
    n_hashes = 2 * side * depth

    def run(batches):
        for table in whole_groups(batches, ["key"]):
            sig, comp, rep, tab = _matrix(table.column("sig"), n_hashes), table.column("comp").to_numpy(), table.column("rep").to_numpy(), table.column("tab").to_numpy()
            for i, j in pairs_in_groups(group_starts(table, ["key"]), 100_000):
                keep = comp[i] != comp[j]
                i, j = i[keep], j[keep]
                keep = (sig[i] == sig[j]).sum(axis=1) >= agree
                i, j = i[keep], j[keep]
                keep = _first_table(sig[i], sig[j], side, depth) == tab[i]
                yield pa.RecordBatch.from_arrays([pa.array(rep[i[keep]]), pa.array(rep[j[keep]])], ["a", "b"])

    return run


def _block_links(side: int, depth: int, agree: int, percent: int):
    n_hashes = 2 * side * depth

    def run(batches):
        for table in whole_groups(batches, ["key", "lo", "hi"], 1):
            comp, rep, tab, block = (table.column(c).to_numpy().copy() for c in ("comp", "rep", "tab", "block"))
            crossing = table.column("lo").to_numpy() != table.column("hi").to_numpy()
            items = [np.asarray(x.values) for x in table.column("items")]
            size = np.array([len(x) for x in items])
            sig = _matrix(table.column("sig"), n_hashes)
            a, b = [], []
            for i, j in pairs_in_groups(group_starts(table, ["key", "lo", "hi"]), 100_000):
                keep = (comp[i] != comp[j]) & (~crossing[i] | (block[i] != block[j])) & (100 * np.minimum(size[i], size[j]) >= percent * np.maximum(size[i], size[j]))
                i, j = i[keep], j[keep]
                keep = (sig[i] == sig[j]).sum(axis=1) >= agree
                i, j = i[keep], j[keep]
                keep = _first_table(sig[i], sig[j], side, depth) == tab[i]
                for x, y in zip(i[keep], j[keep], strict=True):
                    if comp[x] != comp[y]:
                        both = len(np.intersect1d(items[x], items[y], assume_unique=True))
                        if 100 * both >= percent * (size[x] + size[y] - both):
                            a.append(rep[x])
                            b.append(rep[y])
                            comp[comp == comp[y]] = comp[x]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def near_duplicates(docs: DataFrame, percent: int = 85, width: int = 5, side: int = SIDE, depth: int = DEPTH, agree: float = 0.6, large: int = 32, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of `docs`: (doc_id, n_shingles, component_id, kept).

    Words are lower-cased (A-Z); the set of a text is its distinct `width`-word shingles, or its whole word sequence
    if it has fewer words. Texts link when 100 * intersection >= percent * union. Null and empty texts have no set
    and link with nothing. Rows with equal ids count as one document when linking and each is returned; a row with a
    null id has the component of equal sets, if any, and a null component and kept = true otherwise. An empty table
    gives an empty result. Other columns of `docs` are not read. `agree` should lie well below percent / 100.
    """
    agree = round(agree * 2 * side * depth)
    own = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    found = written(features(own, width, 2 * side * depth))
    least = found.where("n > 0 and id is not null").groupBy("h1", "h2").agg(F.min("id").alias("rep"))
    classes = written(least.join(found.select("h1", "h2", F.col("id").alias("rep"), "sig", "n"), ["h1", "h2", "rep"]).dropDuplicates(["h1", "h2", "rep"]))
    tasks = max(1, -(-classes.count() // EMIT))
    keys = classes.select("rep", "sig").repartition(tasks, "rep").mapInArrow(_emit_keys(side, depth), "key long, tab int, rep long")
    shared = keys.groupBy("key").agg(F.min("rep").alias("leader"), F.count("*").alias("members")).where("members > 1")
    members = written(keys.join(shared, "key"))
    ids = members.select(F.col("rep").alias("id")).distinct()

    def sets_of(batches):
        for batch in batches:
            for part in pieces(batch):
                values, first = shingles(*utf8(part.column("text")), width)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values.view(np.int64)))], ["id", "items"])

    sets = written(own.join(ids, "id").mapInArrow(sets_of, "id long, items array<long>"))
    stars = members.where("rep <> leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct()
    links = components(confirmed(stars, sets, percent))
    # what step 1 left open
    placed = members.join(links.select(F.col("node").alias("rep"), "component"), "rep", "left").select("key", "tab", "rep", "members", F.coalesce("component", "rep").alias("comp"))
    mixed = placed.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("key")
    still = written(placed.join(mixed, "key"))
    sigs = classes.select("rep", "sig")
    small = still.where(F.col("members") <= large).join(sigs, "rep")
    pairs = arrow_sorted(small.select("key", "tab", "rep", "comp", "sig"), ["key"], _close_pairs(side, depth, agree), "a long, b long").distinct()
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    big = still.where(F.col("members") > large).withColumn("block", F.pmod(F.xxhash64("rep"), blocks).cast("int"))
    big = big.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))
    big = big.join(sigs, "rep").join(sets.withColumnRenamed("id", "rep"), "rep").select("key", "lo", "hi", "block", "tab", "rep", "comp", "sig", "items")
    more = confirmed(pairs, sets, percent).unionByName(arrow_sorted(big, ["key", "lo", "hi"], _block_links(side, depth, agree, percent), "a long, b long"))
    settled = components(links.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    named = least.join(settled.select(F.col("node").alias("rep"), "component"), "rep", "left").select("h1", "h2", F.coalesce("component", "rep").alias("component"))
    out = found.select("id", "n", "h1", "h2").join(named, ["h1", "h2"], "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, component.isNull()).alias("kept"))


def op10_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    """Contract query: component of every document."""
    return near_duplicates(documents(spark, sf_dir))
