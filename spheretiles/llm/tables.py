"""What the operators share: written intermediate tables, row identity, whole groups in a task, components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all executors see; where that is unset, below /tmp in a single
    process (as in tests), an error on a cluster, whose executors would not see each other's files."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        top = "file:///tmp/checkpoints"
    return f"{top.rstrip('/')}/llm-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """`df` written as Parquet to the shared folder and read again: cuts lineage, computed once, survives lost executors."""
    path = shared_folder(df.sparkSession)
    schema = df.schema
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def row_key(*columns: str) -> Column:
    """A hash of the given columns: rows equal in all of them share it, nulls included."""
    return F.xxhash64(*[F.col(c) for c in columns], *[F.col(c).isNull() for c in columns])


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str], rows: int = 20_000) -> Iterator[pa.Table]:
    """Tables of at least `rows` rows (the last may have fewer) that never split a group; input sorted by `keys`."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < rows:
            continue
        table = pa.Table.from_batches(held)
        changed = np.zeros(count, bool)
        for k in keys:
            values = table.column(k).to_numpy()
            changed[1:] |= values[1:] != values[:-1]
        at = np.flatnonzero(changed)
        if len(at):
            yield table.slice(0, at[-1])
            rest = table.slice(at[-1])
            held, count = rest.to_batches(), rest.num_rows
    if count:
        yield pa.Table.from_batches(held)


def group_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Index of the first row of each group, and the number of rows at the end."""
    changed = np.ones(table.num_rows, bool)
    if table.num_rows > 1:
        changed[1:] = False
        for k in keys:
            values = table.column(k).to_numpy()
            changed[1:] |= values[1:] != values[:-1]
    return np.append(np.flatnonzero(changed), table.num_rows)


def pairs_in_groups(starts: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j), i < j, of rows in one group, in portions of about `most` pairs; stays inside the task."""
    size = np.diff(starts)
    left = np.repeat(starts[1:], size) - np.arange(starts[-1]) - 1  # later rows of the same group
    at, total = 0, np.cumsum(left)
    while at < len(left):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        n = left[at:to]
        i = np.repeat(np.arange(at, to), n)
        if len(i):
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
            yield i, j
        at = to


def arrow_sorted(df: DataFrame, keys: list[str], function: Callable, schema: str, extra: list[str] | None = None) -> DataFrame:
    """function(batches) over partitions dealt by `keys` and sorted by them."""
    return df.repartition(*keys).sortWithinPartitions(*keys, *(extra or [])).mapInArrow(function, schema)


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, component): the smallest node reachable from each node of `edges` (a, b: long, undirected).

    Alternating large-star and small-star steps; each step is an aggregation (combined before its shuffle)
    and a join that Spark may split where a node is hot. A round's edges are written, so nothing is recomputed.
    """
    spark = edges.sparkSession
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        after = written(small.select(F.greatest("e.u", "e.v").alias("u"), F.least("e.u", "e.v").alias("v")).where("u <> v").distinct())
        same = after.exceptAll(now).isEmpty() and now.exceptAll(after).isEmpty()
        now = after
        if same:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
