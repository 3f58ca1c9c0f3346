"""A line that many documents share with different text around it."""

import random

import numpy as np
import pyarrow as pa
import pytest

from spheretiles.llm import substring_dedup as S

from . import brute


def shared_line(n=600):
    rng = random.Random(4)
    line = " ".join(f"licence{i}" for i in range(20))
    word = lambda: f"w{rng.randrange(10**6)}"
    docs = {d: " ".join([*[word() for _ in range(40)], line, *[word() for _ in range(40)]]) for d in range(n)}
    again = {n + d: docs[d] for d in range(0, n, 5)}
    return docs | again | {2 * n: " ".join(["same"] * 90), 2 * n + 1: None}


def test_hot_keys_are_dealt_in_bounded_groups(spark, monkeypatch):
    texts = shared_line()
    docs = spark.createDataFrame(list(texts.items()), "doc long, text string").repartition(6)
    parts = S.slot_parts(docs, 35, 200)
    assert parts.max() >= 32
    sizes = {}
    for at in range(0, len(texts), 100):
        piece = list(texts.items())[at : at + 100]
        batch = pa.RecordBatch.from_arrays([pa.array([d for d, _ in piece], pa.int64()), pa.array([t for _, t in piece])], ["doc", "text"])
        for r in S.windows(batch, 35, parts).to_pylist():
            sizes[r["key"]] = sizes.get(r["key"], 0) + len(r["hashes"] or b"") // 8
    assert max(sizes.values()) <= 3 * 200


@pytest.mark.parametrize("most", [200, 1 << 18])
def test_parts_give_the_same_rows(spark, monkeypatch, most):
    whole = S.repeated_spans
    monkeypatch.setattr(S, "repeated_spans", lambda docs, width: whole(docs, width, most))
    texts = shared_line()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(6)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], brute.sha(r["kept_text"].encode())) for r in S.substring_dedup(docs).collect()}
    assert got == brute.repeats(texts)
    assert np.sum([n for _, n, _ in got.values()]) > 0
