"""Embedding near-dedup: rotated binary codes, multi-index Hamming tables, exact reranking.

Codes are signs after rotations, 16 bits to a table, in two parts:
- `LEARNED` tables by iterative quantisation: on a bounded sample of unit vectors, centred, a rotation is learned that
  brings them close to the corners of a cube, which balances the bits (for each length that the sample holds often).
- `TABLES` tables of signs about the origin after random rotations, whatever the data, so that bits of two vectors agree
  by their angle alone: lengths and an off-centre mean do not matter. Learned rotations alone lose links where the mean
  is far from the origin; these alone keep a pair at cosine 0.93 with probability above 0.999, one at 0.97 above 0.999999.

Vectors of one label and length that share any key are candidates and are compared by exact cosine in double precision.
A pair counts in the first table that it shares only, so no pairs travel: a task returns, for each vector, how many
links it saw and the smallest vector it is connected with there. Equal vectors are one class with a count. Buckets of
over `block` vectors are dealt as pairs of blocks: counting every link of m distinct vectors that are all alike takes
m * m / 2 comparisons, spread over tasks of bounded size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import arrow_sorted, components, documents, group_starts, pairs_in_groups, whole_groups, written
from .words import mix

TABLES, LEARNED, BITS = 64, 8, 16
FITTED = 256  # vectors of a length in the sample from which rotations are learned for it


def usable(vector: str):
    """Not null, no null or non-finite component, not zero."""
    v = F.col(vector)
    return v.isNotNull() & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))


def rotations(d: int, n_bits: int = TABLES * BITS, seed: int = 7) -> np.ndarray:
    """Projection (d, n_bits): as many random rotations as needed, side by side."""
    rng = np.random.default_rng(seed)
    return np.concatenate([np.linalg.qr(rng.normal(size=(d, d)))[0] * rng.choice([-1.0, 1.0], d) for _ in range(-(-n_bits // d))], axis=1)[:, :n_bits]


def stacked(column) -> np.ndarray:
    """A list column of equal lengths as a matrix in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def by_length(table, vector: str):
    """(length, rows) of the distinct lengths of a list column of a batch or table."""
    if table.num_rows:
        size = pa.compute.list_value_length(table.column(vector)).to_numpy(zero_copy_only=False) if isinstance(table, pa.RecordBatch) else pa.compute.list_value_length(table.column(vector)).to_numpy()
        lengths = np.unique(size)
        for d in lengths.tolist():
            yield d, table if len(lengths) == 1 else table.take(pa.array(np.flatnonzero(size == d)))


def units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1)[:, None]  # so that squares stay finite
    return x / np.linalg.norm(x, axis=1)[:, None]


def learned(x: np.ndarray, n_bits: int = LEARNED * BITS, rounds: int = 30, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection (d, n_bits)) by iterative quantisation of unit vectors, as many rotations as needed.

    In turn: the nearest corner for every rotated vector, then the rotation nearest to these corners (by the singular
    vectors of their product).
    """
    x = units(x)
    mean, d, rng = x.mean(axis=0), x.shape[1], np.random.default_rng(seed)
    x = x - mean
    out = []
    for _ in range(-(-n_bits // d)):
        r = np.linalg.qr(rng.normal(size=(d, d)))[0]
        for _ in range(rounds):
            u, _, v = np.linalg.svd(np.where(x @ r > 0, 1.0, -1.0).T @ x)
            r = (u @ v).T
        out.append(r)
    return mean, np.concatenate(out, axis=1)[:, :n_bits]


_fixed: dict[int, np.ndarray] = {}


def _codes(x: np.ndarray, model: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
    """Codes (rows, TABLES + LEARNED); without a model the learned part is a copy of the first tables."""
    d = x.shape[1]
    if d not in _fixed:
        _fixed.clear()
        _fixed[d] = rotations(d)
    x = units(x)
    fixed = np.packbits(x @ _fixed[d] > 0, axis=1).view(np.uint16)
    own = fixed[:, :LEARNED] if model is None else np.packbits((x - model[0]) @ model[1] > 0, axis=1).view(np.uint16)
    return np.concatenate([own, fixed], axis=1)


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest row connected with each row by the pairs."""
    root = np.arange(n)
    while True:
        before = root.copy()
        low = np.minimum(root[i], root[j])
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root = root[root]
        if (root == before).all():
            return root


def _links_of(table, threshold: float) -> pa.RecordBatch | None:
    """(rep, links, root) of vectors of one length that have links in these whole groups."""
    vec, rep, copies, tab, block = stacked(table.column("vec")), table.column("rep").to_numpy(), table.column("copies").to_numpy(), table.column("tab").to_numpy(), table.column("block").to_numpy()
    code = np.frombuffer(b"".join(table.column("code").to_pylist()), np.uint16).reshape(len(rep), -1)
    label, unit = table.column("label").to_numpy(), units(vec)
    crossing = table.column("lo").to_numpy() != table.column("hi").to_numpy()
    count, ii, jj = np.zeros(len(rep), np.int64), [], []
    for i, j in pairs_in_groups(group_starts(table, ["key", "lo", "hi"]), 50_000):
        keep = (label[i] == label[j]) & (~crossing[i] | (block[i] != block[j]))
        i, j = i[keep], j[keep]
        keep = (code[i] == code[j]).argmax(axis=1) == tab[i]
        i, j = i[keep], j[keep]
        keep = np.einsum("ij,ij->i", unit[i], unit[j]) >= threshold
        i, j = i[keep], j[keep]
        np.add.at(count, i, copies[j])
        np.add.at(count, j, copies[i])
        ii.append(i)
        jj.append(j)
    if not ii or not count.any():
        return None
    root = _roots(len(rep), np.concatenate(ii), np.concatenate(jj))
    least = np.full(len(rep), np.iinfo(np.int64).max)
    np.minimum.at(least, root, rep)
    seen = count > 0
    return pa.RecordBatch.from_arrays([pa.array(rep[seen]), pa.array(count[seen]), pa.array(least[root[seen]])], ["rep", "links", "root"])


def _linked(threshold: float):
    def run(batches):
        for table in whole_groups(batches, ["key", "lo", "hi"]):
            for _, part in by_length(table, "vec"):
                found = _links_of(part, threshold)
                if found is not None:
                    yield found

    return run


def embedding_links(vectors: DataFrame, threshold: float = 0.93, sample: int = 8192, block: int = 512, id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of `vectors`.

    Only vectors of equal, non-null labels link, and of equal lengths (others have no cosine). Vectors that are null,
    zero, or hold null or non-finite components link with nothing; so do rows with a null id (their component is null
    and kept is true). Equal vectors link with each other, also in rows that repeat an id. An empty table gives an empty
    result. An id that several rows share with different vectors stands for each of them. Other columns are not read. The learned rotations come from `sample` rows at most, the first by a hash.
    """
    spark = vectors.sparkSession
    own = vectors.select(F.col(id).cast("long").alias("id"), F.col(vector).alias("vec"), F.col(label).alias("label"))
    fit = usable("vec") & F.col("label").isNotNull() & F.col("id").isNotNull()
    good = own.where(fit)
    drawn = good.orderBy(F.xxhash64("id"), "id").limit(sample).select("vec").toPandas()["vec"]
    lengths = [len(v) for v in drawn]
    often = [d for d in set(lengths) if lengths.count(d) >= FITTED]
    models = spark.sparkContext.broadcast({d: learned(np.array([v for v in drawn if len(v) == d], np.float64)) for d in often})  # sample / FITTED models at most
    label_hash = F.xxhash64("label", F.size("vec"))
    classes = written(good.groupBy("label", "vec").agg(F.min("id").alias("least"), F.count("*").alias("copies")).withColumn("label", label_hash).withColumn("rep", F.monotonically_increasing_id()))

    def coded(batches):
        for batch in batches:
            for d, part in by_length(batch, "vec"):
                code = _codes(stacked(part.column("vec")), models.value.get(d))
                yield pa.RecordBatch.from_arrays([part.column("rep"), part.column("label"), pa.array([c.tobytes() for c in code], pa.binary())], ["rep", "label", "code"])

    codes = written(classes.select("rep", "label", "vec").mapInArrow(coded, "rep long, label long, code binary"))
    every = TABLES + LEARNED

    def keys(batches):
        for batch in batches:
            if batch.num_rows:
                code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint16).reshape(-1, every).astype(np.uint64)
                key = mix(batch.column("label").to_numpy().view(np.uint64)[:, None] * np.uint64(3) + code + (np.arange(1, every + 1, dtype=np.uint64) << np.uint64(20)))
                yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), pa.array(np.tile(np.arange(every, dtype=np.int32), len(key))), pa.array(np.repeat(batch.column("rep").to_numpy(), every))], ["key", "tab", "rep"])

    keyed = codes.mapInArrow(keys, "key long, tab int, rep long")
    shared = keyed.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    blocks = F.ceil(F.col("members") / block).cast("int")
    members = keyed.join(shared, "key").withColumn("block", F.pmod(F.xxhash64("rep"), blocks).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other")).drop("members", "other")
    payload = classes.select("rep", "vec", "copies").join(codes, "rep")
    seen = arrow_sorted(members.join(payload, "rep"), ["key", "lo", "hi"], _linked(threshold), "rep long, links long, root long")
    seen = written(seen.groupBy("rep", "root").agg(F.sum("links").alias("links")))
    part = components(seen.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    part = written(part.withColumnRenamed("node", "rep").join(classes.select("rep", "least"), "rep"))
    part = part.join(part.groupBy("component").agg(F.min("least").alias("smallest")), "component").select("rep", "smallest")
    total = seen.groupBy("rep").agg(F.sum("links").alias("links")).join(part, "rep", "left")
    settled = classes.join(total, "rep", "left").select("label", "vec", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("smallest", "least").alias("component"))
    out = own.withColumn("label", F.when(fit, label_hash)).join(settled, ["label", "vec"], "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def op5_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    """Contract query over all of `embeddings`."""
    return embedding_links(documents(spark, sf_dir, "embeddings"))
