"""Approximate nearest neighbours: score-aware anisotropic product quantisation, four-bit table scans, exact reranking.

The smallest Euclidean distance is the largest inner product of (q, 1) with (x, -|x|**2 / 2). The last component is
kept exactly; x is quantised in subspaces of two dimensions with 16 codewords each, under the loss
|r|**2 + (eta - 1) * (r.x)**2 / |x|**2 that weighs the residual parallel to x more, by coordinate descent.

1. Equal vectors are one class with its smallest ids (k + 1 of them suffice), so ties in distance cost no candidates.
2. Codebooks are learned on a bounded sample, one for each length of vectors that it holds often enough. Every class is
   encoded once, two codes to a byte, and written. Vectors of other lengths have no code and are compared exactly.
3. Blocks of queries meet parts of the classes (a query set against all rows, in blocks): a task scans the codes of one
   part with one table of inner products per query, reranks the best `rerank` on the original vectors and returns the
   nearest k. Block and part have bounded sizes whatever the input, and no row passes through the driver.
4. The nearest k of all parts are taken in Spark.

All pairs of a query and a class are scored, so work grows with their product: 32 table reads a pair at 64 dimensions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .embedding_dedup import by_length, stacked, usable
from .tables import documents, written

WORDS = 16
FITTED = 256  # vectors of a length in the sample from which a codebook is learned for it


class Codebook:
    """Codewords (subspaces, 16, 2) for vectors of `d` components (padded to an even number)."""

    def __init__(self, x: np.ndarray, threshold: float = 0.2, sweeps: int = 8, seed: int = 3):
        self.d = x.shape[1]
        x = self._padded(x)
        self.eta1 = max(0.0, (x.shape[1] - 1) * threshold**2 / (1 - threshold**2) - 1)
        rng = np.random.default_rng(seed)
        parts = x.reshape(len(x), -1, 2)
        m = parts.shape[1]
        self.words = np.stack([parts[rng.integers(0, len(x), WORDS), s] for s in range(m)])
        codes = np.stack([((parts[:, s, None] - self.words[s]) ** 2).sum(-1).argmin(1) for s in range(m)], axis=1)
        for _ in range(sweeps):
            codes = self._assign(x, codes)
            self._update(x, codes)

    def _padded(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, x.shape[1] % 2)))

    def _parallel(self, parts: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """(x - reconstruction).x by subspace."""
        chosen = self.words[np.arange(parts.shape[1]), codes]
        return ((parts - chosen) * parts).sum(-1)

    def _assign(self, x: np.ndarray, codes: np.ndarray) -> np.ndarray:
        parts = x.reshape(len(x), -1, 2)
        weight = self.eta1 / (x**2).sum(1)
        along = self._parallel(parts, codes)
        total = along.sum(1)
        for s in range(parts.shape[1]):
            gap = parts[:, s, None] - self.words[s]
            each = (gap * parts[:, s, None]).sum(-1)
            rest = total - along[:, s]
            codes[:, s] = ((gap**2).sum(-1) + weight[:, None] * (rest[:, None] + each) ** 2).argmin(1)
            along[:, s] = each[np.arange(len(x)), codes[:, s]]
            total = rest + along[:, s]
        return codes

    def _update(self, x: np.ndarray, codes: np.ndarray) -> None:
        parts = x.reshape(len(x), -1, 2)
        weight = self.eta1 / (x**2).sum(1)
        for s in range(parts.shape[1]):
            along = self._parallel(parts, codes)
            p = parts[:, s]
            a = along.sum(1) - along[:, s] + (p**2).sum(1)
            for k in range(WORDS):
                mine = codes[:, s] == k
                if mine.any():
                    left = mine.sum() * np.eye(2) + (p[mine] * weight[mine, None]).T @ p[mine]
                    self.words[s, k] = np.linalg.solve(left, p[mine].sum(0) + ((a * weight)[mine, None] * p[mine]).sum(0))

    def encode(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        x = self._padded(x)
        parts = x.reshape(len(x), -1, 2)
        codes = np.stack([((parts[:, s, None] - self.words[s]) ** 2).sum(-1).argmin(1) for s in range(parts.shape[1])], axis=1)
        for _ in range(sweeps):
            codes = self._assign(x, codes)
        return codes.astype(np.uint8)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Inner products (queries, subspaces, 16)."""
        parts = self._padded(q).reshape(len(q), -1, 2)
        return np.einsum("qsd,swd->qsw", parts, self.words).astype(np.float32)


def packed(codes: np.ndarray) -> np.ndarray:
    """Two four-bit codes to a byte."""
    if codes.shape[1] % 2:
        codes = np.pad(codes, ((0, 0), (0, 1)))
    return codes[:, ::2] | codes[:, 1::2] << 4


def _scanned(code: np.ndarray, half_norm: np.ndarray, q: np.ndarray, book: Codebook, take: int) -> np.ndarray:
    """For each query the rows with the `take` largest scores, read off tables for every byte of two codes."""
    table = book.tables(q)
    if table.shape[1] % 2:
        table = np.pad(table, ((0, 0), (0, 1), (0, 0)))
    both = (table[:, 1::2, :, None] + table[:, ::2, None, :]).reshape(len(q), -1, WORDS * WORDS)
    score = np.tile(-half_norm.astype(np.float32), (len(q), 1))
    for s in range(code.shape[1]):
        score += both[:, s, code[:, s]]
    return np.argpartition(-score, take - 1, axis=1)[:, :take]


def _nearest(ids: list, x: np.ndarray, code: np.ndarray | None, q_ids: np.ndarray, q: np.ndarray, book: Codebook | None, k: int, rerank: int):
    """Rows (query, id, distance): the nearest k found for each query among the classes (ids ascending, vector)."""
    out = ([], [], [])
    half_norm = (x**2).sum(axis=1) / 2
    least = np.array([i[0] for i in ids])
    for at in range(0, len(q), 64):
        best = None if book is None or len(x) <= rerank else _scanned(code, half_norm, q[at : at + 64], book, rerank)
        for own in range(at, min(at + 64, len(q))):
            b = np.arange(len(x)) if best is None else best[own - at]
            distance = np.sqrt(((x[b] - q[own]) ** 2).sum(axis=1))
            near = np.lexsort((least[b], distance))[: k + 1]
            found = [(d, i) for d, c in zip(distance[near].tolist(), b[near].tolist(), strict=True) for i in ids[c] if i != q_ids[own]]
            found = sorted(found)[:k]
            out[0].append(np.full(len(found), q_ids[own]))
            out[1].append(np.array([i for _, i in found], np.int64))
            out[2].append(np.array([d for d, _ in found], np.float64))
    return [np.concatenate(o) for o in out]


def classes_of(rows: DataFrame, k: int) -> DataFrame:
    """(vec, ids): distinct vectors and their k + 1 smallest ids; each task passes k + 1 rows of a vector on at most."""
    place = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
    return rows.withColumn("place", place).where(F.col("place") <= k + 1).groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def codebooks(rows: DataFrame, sample: int) -> dict[int, Codebook]:
    """A codebook for each length that `sample` rows (the first by a hash of their ids) hold often enough."""
    drawn = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("vec").toPandas()["vec"]
    lengths = [len(v) for v in drawn]
    often = [d for d in set(lengths) if lengths.count(d) >= FITTED]
    return {d: Codebook(np.array([v for v in drawn if len(v) == d], dtype=np.float64)) for d in sorted(often)}


def encoded(classes: DataFrame, books) -> DataFrame:
    """`classes` with code: the packed codes, null for lengths without a codebook. `books`: broadcast of `codebooks`."""

    def run(batches):
        for batch in batches:
            for d, part in by_length(batch, "vec"):
                book = books.value.get(d)
                if book is None:
                    code = pa.nulls(part.num_rows, pa.binary())
                else:
                    code = pa.array([c.tobytes() for c in packed(book.encode(stacked(part.column("vec"))))], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("vec").cast(pa.list_(pa.float64())), part.column("ids"), code], ["vec", "ids", "code"])

    return classes.mapInArrow(run, "vec array<double>, ids array<long>, code binary")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, sample: int = 8192, rerank: int = 256, query_block: int = 8192, part: int = 8192, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row its k nearest rows of `vectors`, its own id left out.

    The score is the Euclidean distance of the original vectors in double precision; ties go to the smaller id.
    Rows with a null id, or a vector that is null, zero, or holds null or non-finite components, take no part. Vectors of
    different lengths have no distance: each query is searched among those of its own length. With fewer than k
    candidates all are returned; an empty table gives an empty result. Of rows that repeat an id each is a candidate,
    and each query row of a repeated id with another vector counts for that id. Other columns are not read.
    `rerank` is for each part of about `part` distinct vectors, so recall does not fall as the table grows.
    """
    spark = vectors.sparkSession
    pick = lambda df: df.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vec")).where(usable("vec") & F.col("id").isNotNull())
    rows, asked = pick(vectors), pick(queries).distinct()
    books = spark.sparkContext.broadcast(codebooks(rows, sample))  # sample / FITTED small tables at most
    classes = written(encoded(classes_of(rows, k), books))
    counted = lambda df, size: df.groupBy(F.size("vec").alias("d")).agg(F.ceil(F.count("*") / size).cast("int").alias("many"))
    blocks, parts = counted(asked, query_block).withColumnRenamed("many", "blocks"), counted(classes, part).withColumnRenamed("many", "parts")
    grid = blocks.join(parts, "d")  # a row for each length of vectors

    def dealt(df, own, many, other, to, by):
        out = df.withColumn("d", F.size("vec")).join(grid, "d").withColumn(own, F.pmod(F.xxhash64(by), F.col(many)).cast("int"))
        return out.withColumn(to, F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop("blocks", "parts")

    left = dealt(asked, "block", "blocks", "parts", "part", "id").groupBy("d", "block", "part")
    right = dealt(classes, "part", "parts", "blocks", "block", "vec").groupBy("d", "block", "part")

    def scan(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        empty = pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=["query_id", "vec_id", "score"])
        if not mine.num_rows or not theirs.num_rows:
            return empty
        book = books.value.get(mine.column("d")[0].as_py())
        code = None if book is None else np.frombuffer(b"".join(theirs.column("code").to_pylist()), np.uint8).reshape(theirs.num_rows, -1)
        got = _nearest(theirs.column("ids").to_pylist(), stacked(theirs.column("vec")), code, mine.column("id").to_numpy(), stacked(mine.column("vec")), book, k, rerank)
        return pa.table([pa.array(g) for g in got], names=empty.column_names)

    found = left.cogroup(right).applyInArrow(scan, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_vector_search(spark, sf_dir: str) -> DataFrame:
    """Contract query: the 10 nearest of every vector whose id is divisible by 100."""
    rows = documents(spark, sf_dir, "embeddings")
    return nearest(rows, rows.where("vec_id % 100 = 0"))
