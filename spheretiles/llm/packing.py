"""Best-fit packing by minimum bin slack.

Tokenization makes pieces of at most `capacity` tokens. How many pieces have each length is a table of at most
`capacity` rows whatever the input, and on it the bins are planned: for the longest length left, a bitset subset-sum
dynamic program over the lengths still available finds the fullest feasible bin, which is taken out as often as the
counts allow. Pieces are then numbered within their length (by salted groups and their running totals, as many as a
length asks for, so that a common one is not one task), and a number says which bin of the plan a piece is in and where.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .pretokens import Pieces
from .tables import documents, written
from .words import pieces, utf8

GROUP = 1 << 18  # pieces of one length, about, that are numbered in one group
_loaded: dict = {}


def loaded(path: str):
    """The tokenizer, and its ids of the pre-tokenized pieces seen so far in this worker."""
    if path not in _loaded:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        whole, single = Tokenizer.from_file(path), Tokenizer.from_file(path)
        single.encode_special_tokens = True
        single.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)

        def encode(raw: list[bytes]) -> list[np.ndarray]:
            return [np.array(e.ids, np.uint32) for e in single.encode_batch_fast([r.decode() for r in raw], add_special_tokens=False)]

        special = [t.content.encode() for t in whole.get_added_tokens_decoder().values()]
        _loaded[path] = whole, Pieces(encode), special
    return _loaded[path]


def token_ids(column: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids, first id of each text). A text that holds a special token's string goes through the tokenizer whole."""
    whole, cache, special = loaded(path)
    data, offsets = utf8(column)
    ids, first = cache.ids(data, offsets)
    raw = data.tobytes()
    if any(s in raw for s in special):
        parts = []
        for d in range(len(offsets) - 1):
            body = raw[offsets[d] : offsets[d + 1]]
            odd = any(s in body for s in special)
            parts.append(np.array(whole.encode(body.decode(), add_special_tokens=False).ids, np.uint32) if odd else ids[first[d] : first[d + 1]])
        first = np.append(0, np.cumsum([len(p) for p in parts]))
        ids = np.concatenate(parts) if parts else ids
    return ids, first


def cut(docs: DataFrame, path: str, capacity: int, end: int, id: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): each document's ids and `end`, cut into pieces of `capacity`; the first may be shorter."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch):
                ids, first = token_ids(part.column("text"), path)
                n = np.diff(first) + 1
                ids = np.insert(ids, first[1:], end).astype("<u4")
                begin = np.cumsum(n) - n
                count = -(-n // capacity)
                short = n - (count - 1) * capacity
                doc = np.repeat(np.arange(len(n)), count)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                start = np.where(piece == 0, 0, short[doc] + (piece - 1) * capacity)
                length = np.where(piece == 0, short[doc], capacity)
                at = begin[doc] + start
                bodies = [ids[a : a + k].tobytes() for a, k in zip(at, length, strict=True)]
                columns = [part.column("doc_id").take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array([zlib.crc32(b) for b in bodies], pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, *([pa.array(bodies, pa.binary())] if keep_ids else [])], ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    return docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def plan(counts: dict[int, int], capacity: int) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """(how many bins, [(length, pieces of it in each)]): minimum bin slack on the counts of lengths."""
    left = {n: c for n, c in counts.items() if c}
    while left:
        longest = max(left)
        room = capacity - longest
        left[longest] -= 1
        order = sorted((n for n, c in left.items() if c and n <= room), reverse=True)
        reach = [1]  # bit t of reach[k]: the first k lengths can fill exactly t
        mask = (1 << (room + 1)) - 1
        for n in order:
            bits, many, step = reach[-1], min(left[n], room // n), 1
            while many:  # binary splitting of the multiplicity
                take = min(step, many)
                bits |= (bits << (n * take)) & mask
                many -= take
                step *= 2
            reach.append(bits)
            if bits >> room & 1:
                break
        left[longest] += 1
        target = reach[-1].bit_length() - 1
        used = {longest: 1}
        for k in range(len(reach) - 1, 0, -1):
            while not reach[k - 1] >> target & 1:
                target -= order[k - 1]
                used[order[k - 1]] = used.get(order[k - 1], 0) + 1
        bins = min(left[n] // u for n, u in used.items())
        for n, u in used.items():
            left[n] -= bins * u
            if not left[n]:
                del left[n]
        yield bins, sorted(used.items(), reverse=True)


def place(parts: DataFrame, capacity: int) -> DataFrame:
    """`parts` (with doc_id, piece, length; read more than once) with sequence_id and offset added."""
    spark = parts.sparkSession
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    slots, done, first = [], {}, 0
    for bins, used in plan(counts, capacity):
        base = 0
        for n, u in used:
            low = done.get(n, 0)
            done[n] = low + bins * u
            slots.append((n, low, done[n], u, first, base))
            base += n * u
        first += bins
    table = spark.createDataFrame(slots, "length long, low long, high long, uses long, first_bin long, base long")  # bounded by the number of lengths, not of pieces
    many = spark.createDataFrame([(n, -(-c // GROUP)) for n, c in counts.items()], "length long, salts long")  # capacity rows at most
    salted = parts.join(F.broadcast(many), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("salts")).cast("int")).drop("salts")
    groups = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = groups.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).drop("n")
    number = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    numbered = salted.withColumn("number", number).join(F.broadcast(before), ["length", "salt"]).withColumn("number", F.col("number") + F.col("before"))  # a row for each length and 262,144 pieces of it: 60,000 rows for 1.5e10 pieces
    found = numbered.join(F.broadcast(table), (numbered.length == table.length) & (F.col("number") >= F.col("low")) & (F.col("number") < F.col("high"))).drop(table.length)
    turn = F.col("number") - F.col("low")
    return found.withColumn("sequence_id", F.col("first_bin") + F.floor(turn / F.col("uses"))).withColumn("offset", F.col("base") + (turn % F.col("uses")) * F.col("length")).drop("salt", "number", "before", "low", "high", "uses", "first_bin", "base")


def pack(docs: DataFrame, path: str, capacity: int = 1024, end: int = 2, id: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset): every document's tokens packed into sequences.

    path: tokenizer file, present on every executor. Null and empty texts have the end id only. Null doc_ids stay null
    and repeated rows are packed each. An empty table gives an empty result. Other columns are not read.
    """
    return place(written(cut(docs, path, capacity, end, id, text, keep_ids)), capacity)


def op2_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """Contract query: pieces of all documents and their places."""
    import public_tokenizers

    return pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
