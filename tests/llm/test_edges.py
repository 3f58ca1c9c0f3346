"""Rows that repeat, null ids, empty tables and columns whose names clash, for every operator on texts."""

from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from spheretiles.llm import bpe, minhash_dedup, packing, pii, quality, substring_dedup, toxicity
from spheretiles.llm.words import utf8

LONG = " ".join(f"w{i % 900}" for i in range(1500))
ROWS = [(1, "one two three"), (1, "one two three"), (None, "one two three"), (None, None), (None, ""), (2, None), (3, LONG), (3, LONG), (4, LONG + " end"), (5, "x"), (5, "y")]
NAMES = "doc_id long, text string, __m string, __base string, row string, h string, slice string, key string, n string, bucket string, salt string, number string, tab string, at string"


@pytest.fixture(scope="module", params=[ROWS, []], ids=["rows", "empty"])
def docs(request, spark):
    return spark.createDataFrame([r + ("c",) * 12 for r in request.param], NAMES), request.param


def model():
    return np.zeros(toxicity.BUCKETS, np.float32), -5.0


OPERATORS = {
    "pii": lambda d: pii.pii(d),
    "quality": lambda d: quality.resample(d, d.sparkSession.createDataFrame([(3, 1)], "doc_id long, quality int")),
    "bpe": lambda d: bpe.encode(d, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), decoded=True),
    "toxicity": lambda d: toxicity.toxicity(d, model()),
    "substrings": lambda d: substring_dedup.substring_dedup(d),
    "minhash": lambda d: minhash_dedup.near_duplicates(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_comes_back(docs, name):
    df, rows = docs
    assert Counter(r["doc_id"] for r in OPERATORS[name](df).collect()) == Counter(d for d, _ in rows)


def test_packing_packs_every_row(docs):
    df, rows = docs
    got = packing.pack(df, public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert Counter(r["doc_id"] for r in got if r["piece"] == 0) == Counter(d for d, _ in rows)
    places = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == places.get(r["sequence_id"], 0)
        places[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(places.values(), default=0) <= 1024


def test_repeated_rows_lose_their_windows(docs):
    df, rows = docs
    got = substring_dedup.substring_dedup(df).where("doc_id in (3, 4)").collect()
    assert not rows or sorted((r["n_words"], r["n_removed"]) for r in got) == [(1500, 1500), (1500, 1500), (1501, 1500)]


def test_repeated_rows_are_one_group(docs):
    df, rows = docs
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in minhash_dedup.near_duplicates(df).collect()}
    assert not rows or {(1, 1, True), (3, 3, True), (4, 3, False), (2, 2, True), (None, 1, False)} <= got


def test_draws_of_the_quality_sample(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    table = docs.select("doc_id", "text", F.xxhash64(F.lit(17), F.xxhash64("doc_id", "text")).alias("h")).toArrow()
    good = {r["doc_id"] for r in labels.where("quality = 1").collect()}
    raw, target = np.ones(quality.BUCKETS), np.ones(quality.BUCKETS)
    each = []
    for d, t in zip(table["doc_id"].to_pylist(), table["text"].to_pylist(), strict=True):
        import pyarrow as pa

        _, b = quality._features(pa.array([t or ""]))
        each.append(b.tolist())
        for x in b.tolist():
            raw[x] += 1
            target[x] += d in good
    weight = [sum(np.log(target[x] / target.sum()) - np.log(raw[x] / raw.sum()) for x in b) for b in each]
    u = [((h & ((1 << 52) - 1)) + 0.5) / (1 << 52) for h in table["h"].to_pylist()]
    draw = np.array(weight) - np.log(-np.log(u))
    cut = np.sort(draw)[-int(np.ceil(len(draw) / 2))]
    got = {r["doc_id"]: r for r in quality.resample(docs, labels).collect()}
    for i, d in enumerate(table["doc_id"].to_pylist()):
        assert abs(got[d]["log_weight"] - weight[i]) < 1e-6 and abs(got[d]["draw"] - draw[i]) < 1e-6
        assert got[d]["kept"] == (draw[i] >= cut)


def test_words_in_quality_are_counted_once_each():
    import pyarrow as pa

    doc, bucket = quality._features(pa.array(["a b A", "", None, "c"]))
    assert np.bincount(doc, minlength=4).tolist() == [5, 0, 0, 1]
    assert bucket[0] == bucket[2] and len(utf8(pa.array(["a"]))[0]) == 1
