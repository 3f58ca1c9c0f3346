"""Noisy-or scores, located sentences, and a fit that reads long texts too."""

import numpy as np
import pytest

from spheretiles.llm import toxicity as X
from spheretiles.llm.words import utf8

BAD, GOOD = ["you are a vile zorgle", "zorgle scum leave now"], ["the weather is mild today", "we walked to the river", "bread is baked at dawn", "a letter came by post"]


def corpus(n=400, sentences=4):
    """Documents of `sentences` sentences; the odd ones hold a bad one at place k % sentences."""
    out = []
    for k in range(n):
        parts = [f"{GOOD[(k + j) % 4]} {k % 7}" for j in range(sentences)]
        if k % 2:
            parts[k % sentences] = BAD[k % 4 // 2]
        out.append((k, ". ".join(parts) + ".", k % 2))
    return out


@pytest.fixture(scope="module")
def model(spark):
    rows = corpus()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    return X.train(docs, spark.createDataFrame([(d, y) for d, _, y in rows], "doc_id long, toxic int"))


def test_scores_are_the_noisy_or_of_the_sentences(spark, model):
    rows = corpus(40)
    rows += [(100, None, 0), (101, "", 0), (102, " .. !", 0), (103, rows[1][1], 1)]
    docs = spark.createDataFrame([(d, t, "kept") for d, t, _ in rows], "doc_id long, text string, tox_score string")
    got = {r["doc_id"]: r for r in X.toxicity(docs, model, least=0.0).collect()}
    for d, t, y in rows:
        p = [s["score"] for s in got[d]["tox_sentences"]]
        assert abs(got[d]["tox_score"] - (1 - np.prod([1 - x for x in p]))) < 1e-9
        assert got[d]["tox_worst"] is None if not p else got[d]["tox_worst"]["score"] == max(p)
        assert (got[d]["tox_score"] >= 0.5) == bool(y)
    assert got[103]["tox_score"] == got[1]["tox_score"] and got[100]["tox_score"] == got[102]["tox_score"] == 0


def test_offending_sentences_are_located(spark, model):
    text = "é " + GOOD[0] + ". " + BAD[0] + "! " + GOOD[1] + ". " + BAD[1] + "."
    r = X.toxicity(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    raw = text.encode()
    assert [raw[s["at"] :].decode().split()[0] for s in r["tox_sentences"]] == ["you", "zorgle"]
    assert all(s["score"] >= 0.5 for s in r["tox_sentences"]) and r["tox_worst"]["at"] in [s["at"] for s in r["tox_sentences"]]


def test_long_labelled_texts_are_learned_from(spark):
    rows = corpus(120, 400)  # over 10,000 characters each
    assert min(len(t) for _, t, _ in rows) > 10_000
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    known = spark.createDataFrame([(d, y) for d, _, y in rows], "doc_id long, toxic int")
    weights, bias = X.train(docs, known)
    scores = X.scores(*utf8(__import__("pyarrow").array(BAD + GOOD)), weights, bias)[0]
    assert scores[:2].min() > scores[2:].max()


def test_the_budget_holds_whatever_the_ids(spark):
    rows = corpus(60)
    docs = spark.createDataFrame([(1, t) for _, t, _ in rows] * 50, "doc_id long, text string")  # one id for all rows
    known = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    weights, _ = X.train(docs, known, budget=2000, held_out=False)
    assert np.isfinite(weights).all()


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    known = spark.createDataFrame([], "doc_id long, toxic int")
    model = X.train(docs, known)
    assert X.toxicity(docs, model).count() == 0
