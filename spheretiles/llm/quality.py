"""Quality by importance resampling: the ratio of hashed n-gram models of target and raw text, drawn by Gumbel top-k.

Both models are bags of word unigrams and bigrams hashed to `BUCKETS` buckets, with add-one smoothing: the target model
from a bounded number of documents labelled of good quality, the raw model from all documents. The counts are 10,000 numbers whatever the
input, added up from one row of counts per bucket and task. A document's log weight is the sum of log(target / raw)
over its n-grams. Adding Gumbel noise and taking the k largest draws k documents without replacement in proportion
to their weights; the noise is a hash of seed, id and text, so a draw can be repeated.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import documents, written
from .words import mix, owner, pieces, utf8, words

BUCKETS = 10_000
RANKED = 1 << 20  # rows of a range of draws, about: the range with the cut is ranked in one task


def _features(column) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of every unigram and bigram, lower-cased."""
    h, _, _, first = words(*utf8(column), lower=True)
    doc = owner(first)
    same = doc[1:] == doc[:-1]
    two = mix(h[:-1] * np.uint64(0xD6E8FEB86659FD93) + h[1:])[same]
    return np.concatenate([doc, doc[1:][same]]), (np.concatenate([h, two]) % np.uint64(BUCKETS)).astype(np.int64)


def fit(docs: DataFrame, labels: DataFrame, targets: int = 20_000, id: str = "doc_id", text: str = "text") -> np.ndarray:
    """Log ratio of each bucket. A document is target where `labels` (doc_id, quality) marks its id 1 in any row.

    The target model is fitted on at most `targets` such ids, the first by a hash of the id; the raw model on all rows.
    """
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("id")).distinct()
    good = good.orderBy(F.xxhash64("id"), "id").limit(targets).withColumn("target", F.lit(1))
    marked = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).join(F.broadcast(good), "id", "left")  # at most `targets` ids

    def count(batches):
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for part in pieces(batch):
                doc, bucket = _features(part.column("text"))
                is_target = part.column("target").is_valid().to_numpy(zero_copy_only=False)
                raw += np.bincount(bucket, minlength=BUCKETS)
                target += np.bincount(bucket[is_target[doc]], minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS)), pa.array(raw), pa.array(target)], ["bucket", "raw", "target"])

    counts = marked.select("text", "target").mapInArrow(count, "bucket long, raw long, target long")
    raw, target = np.ones(BUCKETS), np.ones(BUCKETS)
    for r in counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect():  # BUCKETS rows
        raw[r["bucket"]] += r["raw"]
        target[r["bucket"]] += r["target"]
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def log_weights(docs: DataFrame, ratio: np.ndarray, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, tie, log_weight): `tie` is a hash of id and text, equal for repeated rows only."""
    sent = docs.sparkSession.sparkContext.broadcast(ratio)  # 80 kB

    def weigh(batches):
        for batch in batches:
            for part in pieces(batch):
                doc, bucket = _features(part.column("text"))
                weight = np.bincount(doc, sent.value[bucket], part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("tie"), pa.array(weight.astype(np.float64))], ["id", "tie", "log_weight"])

    keyed = docs.select(F.col(id).cast("long").alias("id"), F.xxhash64(id, text).alias("tie"), F.col(text).alias("text"))
    return keyed.mapInArrow(weigh, "id long, tie long, log_weight double").withColumnRenamed("id", id)


def resample(docs: DataFrame, labels: DataFrame, share: float = 0.5, seed: int = 17, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, log_weight, draw, kept) of every row; kept marks the ceil(share * rows) largest draws.

    A null or empty text has log weight 0 and takes part. A null id stays null. Repeated rows have equal draws: which
    of them are kept at the cut is arbitrary, how many is not. Without target documents the target model is uniform.
    An empty table gives an empty result. Other columns of `docs` are not read.

    Draws are dealt by range and written with their partition, so that only the partition with the cut is ranked.
    """
    weighed = log_weights(docs, fit(docs, labels, id=id, text=text), id, text)
    u = (F.xxhash64(F.lit(seed), "tie").bitwiseAND(F.lit((1 << 52) - 1)) + 0.5) / float(1 << 52)
    drawn = weighed.withColumn("draw", F.col("log_weight") - F.ln(-F.ln(u)))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // RANKED))
    ranged = written(drawn.repartitionByRange(parts, F.desc("draw"), "tie").withColumn("part", F.spark_partition_id()))
    counts = sorted(ranged.groupBy("part").count().collect())  # a row a partition
    k, before, cut = int(np.ceil(share * sum(n for _, n in counts) - 1e-9)), 0, -1
    for part, n in counts:
        if before + n >= k:
            cut = part
            break
        before += n
    rank = F.row_number().over(Window.partitionBy("part").orderBy(F.desc("draw"), "tie"))
    at_cut = ranged.where(F.col("part") == cut).withColumn("kept", rank <= k - before)
    others = ranged.where(F.col("part") != cut).withColumn("kept", F.col("part") < cut)
    return others.unionByName(at_cut).select(id, "log_weight", "draw", "kept")


def op3_quality_resampling(spark, sf_dir: str) -> DataFrame:
    """Half of all documents drawn towards those labelled of good quality."""
    out = resample(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))
    return out.select("doc_id", F.round("log_weight", 6).alias("log_weight"), F.round("draw", 6).alias("draw"), "kept")
