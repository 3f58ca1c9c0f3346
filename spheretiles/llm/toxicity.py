"""Toxicity by multiple-instance learning: a text is a bag of sentences, its score the noisy-or of theirs.

Sentence scores are logistic in hashed features: each word and its prefixes of 4, 5 and 6 bytes (ASCII letters
lower-cased), each counted once a sentence at most in effect (weights are clipped by the logistic). Training sees
document labels only: with p(sentence) = s(w.x + b) the document has 1 - prod(1 - p), and the gradient of its
likelihood moves the sentences that explain a toxic label. The fit uses a bounded, documented sample of labelled rows
(`positives` toxic and `negatives` clean ids, in the order of a hash, with as many of their texts as fit into `budget`
bytes together, whatever each one's length; both classes are weighed to their true shares), in one task. Scoring covers
whole texts of every document and then locates the sentences that offend.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import documents
from .words import _LOWER, _hashed, owner, pieces, utf8

BUCKETS = 1 << 20
PREFIXES = (4, 5, 6)
_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_END = np.zeros(256, bool)
_END[list(b".!?\n")] = True


def sentence_features(data: np.ndarray, offsets: np.ndarray):
    """(feature buckets, sentence of each, document of each sentence, byte start of each sentence)."""
    data = _LOWER[data]
    inside = _LETTER[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1] | edge[1:-1]
    closes[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    first = np.searchsorted(starts, offsets)
    doc = owner(first)
    number = np.cumsum(_END[data])[starts] if len(starts) else np.empty(0, np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (number[1:] != number[:-1]) | (doc[1:] != doc[:-1])
    sentence = np.cumsum(new) - 1
    found, where = [_hashed(data, starts, ends)], [sentence]
    for n in PREFIXES:
        long = np.flatnonzero(ends - starts >= n)
        found.append(_hashed(data, starts[long], starts[long] + n) * np.uint64(2 * n + 1))
        where.append(sentence[long])
    return (np.concatenate(found) >> np.uint64(44)).astype(np.int64), np.concatenate(where), doc[new], starts[new]


def fit(texts: pa.Array, y: np.ndarray, weight: np.ndarray, steps: int = 100, rate: float = 0.3, decay: float = 2e-3, seen_in: int = 4, short: int = 20) -> tuple[np.ndarray, float]:
    """Weights by bucket and the bias: Adam on the noisy-or likelihood of the document labels.

    The label of a bag of many sentences says little about each: beyond `short` ones, bags weigh less by the square root.
    """
    bucket, sentence, of, _ = sentence_features(*utf8(texts))
    once = np.unique(sentence * BUCKETS + bucket)
    del bucket, sentence
    often = np.bincount(once % BUCKETS, minlength=BUCKETS) >= seen_in
    once = once[often[once % BUCKETS]]
    used, renamed = np.flatnonzero(often), (np.cumsum(often) - 1).astype(np.int32)
    code, sentence = renamed[once % BUCKETS], (once // BUCKETS).astype(np.int32)
    del once
    n, w, b = len(of), np.zeros(len(used)), -5.0
    m, v, mb, vb = np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0
    weight = weight * np.sqrt(np.minimum(1, short / np.maximum(1, np.bincount(of, minlength=len(y)))))
    total = weight.sum()
    for t in range(1, steps + 1):
        z = np.clip(b + np.bincount(sentence, w[code], n), -30, 30)
        p = 1 / (1 + np.exp(-z))
        none = np.exp(np.bincount(of, -np.log1p(np.exp(z)), len(y)))  # no sentence is toxic
        pull = np.where(y == 1, -np.minimum(none, 1 - 1e-9) / np.maximum(1 - none, 1e-9), 1.0) * weight
        g = pull[of] * p
        gw = np.bincount(code, g[sentence], len(used)) / total + decay / 100 * w
        gb = g.sum() / total
        m, v, mb, vb = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw**2, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        b -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-8)
    weights = np.zeros(BUCKETS, np.float32)
    weights[used] = w
    return weights, b


def train(docs: DataFrame, labels: DataFrame, positives: int = 2048, negatives: int = 3072, budget: int = 24 << 20, held_out: bool = True, id: str = "doc_id", text: str = "text") -> tuple[np.ndarray, float]:
    """The model, from labelled rows whose crc32(id) mod 5 is not 0 (all labelled rows if not held_out).

    Without labelled texts every score is the one that the starting bias gives.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1) and id is not null")
    if held_out:
        known = known.where(F.crc32(F.col("id").cast("string")) % 5 != 0)
    counts = dict(known.groupBy("toxic").count().collect())
    order = [F.xxhash64("id"), F.col("id")]
    drawn = known.where("toxic = 1").orderBy(*order).limit(positives).unionByName(known.where("toxic = 0").orderBy(*order).limit(negatives))
    bodies = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).where("text is not null")
    sample = bodies.join(F.broadcast(drawn), "id").select(F.xxhash64("id").alias("draw"), "id", "text", "toxic")  # at most positives + negatives ids

    def learn(batches):
        texts, y, size = [], [], 0
        for batch in batches:  # sorted; a text that does not fit any more is left out, later and shorter ones may fit
            long = pa.compute.binary_length(batch.column("text")).to_numpy(zero_copy_only=False)
            keep = []
            for i, n in enumerate(long.tolist()):
                if size + n <= budget or not y and not keep:
                    keep.append(i)
                    size += n
            part = batch.take(pa.array(keep, pa.int64()))
            texts.append(part.column("text"))
            y += part.column("toxic").to_pylist()
        if not y:
            return
        y = np.array(y)
        share = {c: counts.get(c, 0) / max(1, int((y == c).sum())) for c in (0, 1)}
        weights, bias = fit(pa.concat_arrays(texts), y, np.where(y == 1, 1.0, share[0] / max(share[1], 1e-9)))
        yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary()), pa.array([bias])], ["weights", "bias"])

    got = sample.repartition(1).sortWithinPartitions("draw", "id", "text").mapInArrow(learn, "weights binary, bias double").collect()
    if not got:
        return np.zeros(BUCKETS, np.float32), -5.0
    return np.frombuffer(got[0]["weights"], np.float32), got[0]["bias"]


def scores(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray, bias: float):
    """(score of each document, score of each sentence, document of each sentence, byte place of each sentence in its text)."""
    bucket, sentence, of, place = sentence_features(data, offsets)
    # a feature that a sentence repeats counts once
    active = np.flatnonzero(weights[bucket])
    bucket, sentence = bucket[active], sentence[active]
    once = np.unique(sentence * BUCKETS + bucket)
    z = np.clip(bias + np.bincount(once // BUCKETS, weights[once % BUCKETS].astype(np.float64), len(of)), -30, 30)
    none = np.bincount(of, -np.log1p(np.exp(z)), len(offsets) - 1)
    return -np.expm1(none), 1 / (1 + np.exp(-z)), of, place - offsets[of]


def toxicity(docs: DataFrame, model: tuple[np.ndarray, float], text: str = "text", least: float = 0.5) -> DataFrame:
    """`docs` with tox_score (0 to 1), tox_worst (at, score: the most toxic sentence, the first of equal ones; null
    without words) and tox_sentences (all with a score of `least` or more, in order) added; places are bytes of the first
    word in UTF-8. All columns stay (columns with these names are replaced).

    Null texts are empty; a text without words has score 0, as no sentence can be toxic. Equal texts have equal
    scores. An empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 4 MB, whatever the input
    added = ("tox_score", "tox_worst", "tox_sentences")
    base = [f for f in docs.schema.fields if f.name not in added]
    one = T.StructType([T.StructField("at", T.LongType()), T.StructField("score", T.DoubleType())])
    schema = T.StructType([*base, T.StructField(added[0], T.DoubleType()), T.StructField(added[1], one), T.StructField(added[2], T.ArrayType(one))])
    struct = lambda at, p, mask=None: pa.StructArray.from_arrays([pa.array(at), pa.array(p)], ["at", "score"], mask=mask)

    def run(batches):
        weights, bias = sent.value
        for batch in batches:
            for part in pieces(batch, text):
                score, each, of, at = scores(*utf8(part.column(text)), weights, bias)
                worst_at, worst = np.full(part.num_rows, -1, np.int64), np.zeros(part.num_rows)
                order = np.lexsort((-at, each, of))
                last = order[np.append(of[order][1:] != of[order][:-1], True)] if len(of) else order
                worst_at[of[last]], worst[of[last]] = at[last], each[last]
                high = np.flatnonzero(each >= least)
                found = pa.ListArray.from_arrays(pa.array(np.searchsorted(of[high], np.arange(part.num_rows + 1)).astype(np.int32)), struct(at[high], each[high]))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score), struct(worst_at, worst, pa.array(worst_at < 0)), found], [*part.schema.names, *added])

    return docs.select(*[F.col(f"`{f.name}`") for f in base]).mapInArrow(run, schema)


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    """Contract query: every document's score; rows with crc32(doc_id) mod 5 = 0 are held out of training."""
    docs = documents(spark, sf_dir)
    model = train(docs, documents(spark, sf_dir, "labels"))
    out = toxicity(docs.select("doc_id", "text"), model)
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    score = F.col("tox_score")
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"), "tox_worst", "tox_sentences")
