"""Slices, buckets and answers of LM scoring, on rows that repeat and words that are hot."""

import math
from collections import Counter

import pytest

from spheretiles.llm import lm_scoring

from . import brute


def plain(texts, least=2, backoff=0.4):
    words = [brute.WORD.findall(t or "") for t in texts]
    c = Counter(tuple(w[i : i + k]) for w in words for k in (1, 2, 3) for i in range(len(w) - k + 1))
    total = sum(map(len, words))
    out = []
    for w in words:
        ln = []
        for i in range(len(w)):
            three, two = tuple(w[i - 2 : i + 1]) if i > 1 else None, tuple(w[i - 1 : i + 1]) if i else None
            if three and c[three] >= least:
                ln.append(math.log(c[three] / c[three[:2]]))
            elif two and c[two] >= least:
                ln.append(math.log(c[two] / c[two[:1]]) + (math.log(backoff) if three else 0))
            else:
                ln.append(math.log(c[(w[i],)] / total) + min(i, 2) * math.log(backoff))
        out.append((len(w), sum(ln) / len(ln) if ln else None))
    return out


TEXTS = [None, "", " \t", "one", "one two", "the the the the the", "the cat sat on the mat and the cat sat", *["a licence line that many share, word for word"] * 40, *[f"the w{i % 7} of the w{i % 5} " * 30 for i in range(60)], " ".join(f"x{i % 400}" for i in range(20_000))]


@pytest.mark.parametrize("least", [1, 2, 3])
def test_scores_equal_brute_force(spark, monkeypatch, least):
    monkeypatch.setattr(lm_scoring, "SLICE", 3000)
    monkeypatch.setattr(lm_scoring, "BUCKET", 500)
    rows = [(i if i % 9 else None, t, i) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows + rows[-3:], "doc_id long, text string, slice long")  # repeated rows, null ids, a clashing name
    texts = [t for _, t, _ in rows + rows[-3:]]
    got = sorted((r["doc_id"] or -1, r["n_words"], None if r["lm_score"] is None else round(r["lm_score"], 9)) for r in lm_scoring.lm_scores(docs, least=least).collect())
    want = sorted((d or -1, n, None if s is None else round(s, 9)) for (d, _, _), (n, s) in zip(rows + rows[-3:], plain(texts, least), strict=True))
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=str), sorted(want, key=str), strict=True):
        assert g[:2] == w[:2] and (g[2] is None) == (w[2] is None) and (g[2] is None or abs(g[2] - w[2]) < 1e-8)


def test_keys_of_very_many_words():
    import numpy as np
    import pyarrow as pa

    for words_in_all in (0, 1, 10**9, 5 * 10**12, 10**13, 10**14):
        lead, extra = lm_scoring.key_bits(words_in_all)
        assert lead + extra <= 64 and lead < 31 and 3 * words_in_all / 2**lead <= lm_scoring.BUCKET
        grams = lm_scoring.Grams(pa.array(["a b c a b", "a b"]), lead + extra)
        sent = lm_scoring._sent(0, grams, extra)
        keys = []
        for r in sent.to_pylist():
            gap = np.zeros((r["n"], 8), np.uint8)
            width = len(r["low"]) // r["n"] + 1
            gap[:, : width - 1] = np.frombuffer(r["low"], np.uint8).reshape(r["n"], -1)
            gap[:, width - 1] = lm_scoring._restored(r["top"], r["n"], np.uint8)
            keys += [(r["bucket"] << extra) + k for k in (r["base"] + np.cumsum(gap.view("<i8")[:, 0])).tolist()]
        assert keys == grams.distinct.tolist() and grams.times.sum() == 7 + 5 + 3


def test_words_seen_once_count(spark):
    """The registered query cuts nothing off: n-grams seen once have their counts."""
    docs = spark.createDataFrame([(1, "a b c"), (2, "a b d")], "doc_id long, text string")
    got = {r["doc_id"]: r["lm_score"] for r in lm_scoring.lm_scores(docs).collect()}
    want = (math.log(2 / 6) + math.log(2 / 2) + math.log(1 / 2)) / 3
    assert got == {1: pytest.approx(want), 2: pytest.approx(want)}


def elsewhere(texts, backoff):
    """Scores by the counts of the other texts, each counted anew."""
    words = [brute.WORD.findall(t or "") for t in texts]
    counts = [Counter(tuple(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)) for w in words]
    every = sum(counts, Counter())
    total, out = sum(map(len, words)), []
    for w, own in zip(words, counts, strict=True):
        c, ln = {g: every[g] - own[g] for g in own}, []
        for i in range(len(w)):
            three, two = tuple(w[i - 2 : i + 1]) if i > 1 else None, tuple(w[i - 1 : i + 1]) if i else None
            if three and c[three]:
                ln.append(math.log(c[three] / c[three[:2]]))
            elif two and c[two]:
                ln.append(math.log(c[two] / c[two[:1]]) + (math.log(backoff) if three else 0))
            else:
                ln.append(math.log(every[(w[i],)] / total) + min(i, 2) * math.log(backoff))
        out.append((len(w), round(sum(ln) / len(ln), 7) if ln else None))
    return out


@pytest.mark.parametrize("backoff", [0.4, 0.01])
def test_others_equal_brute_force(spark, monkeypatch, backoff):
    monkeypatch.setattr(lm_scoring, "SLICE", 3000)
    monkeypatch.setattr(lm_scoring, "BUCKET", 500)
    texts = [*TEXTS, TEXTS[-2], "a text that no other knows at all", "the cat sat on a text that no other knows"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_words"], r["lm_score"] and round(r["lm_score"], 7) + 0.0) for r in lm_scoring.lm_scores(docs, backoff=backoff, others=True).collect())
    for (_, n, score), (m, want) in zip(got, elsewhere(texts, backoff), strict=True):
        assert n == m and (score == want or abs(score - want) < 2e-7)


def test_the_registered_query_backs_off(spark, monkeypatch):
    """Words that no other document has after these words take the lower levels, in the query and in its SQL."""
    import duckdb

    docs = spark.createDataFrame([(1, "a b c"), (2, "a b d"), (3, "a b d")], "doc_id long, text string")
    monkeypatch.setattr(lm_scoring, "documents", lambda *_: docs)
    got = {r["doc_id"]: r["lm_score"] for r in lm_scoring.op7_lm_scoring(spark, "").collect()}
    first = math.log(3 / 9) + math.log(2 / 2)
    want = {1: (first + math.log(1 / 9) + 2 * math.log(0.4)) / 3, 2: (first + math.log(1 / 2)) / 3, 3: (first + math.log(1 / 2)) / 3}
    assert got == pytest.approx(want, abs=1e-6)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents AS SELECT * FROM (VALUES (1, 'a b c'), (2, 'a b d'), (3, 'a b d')) t(doc_id, text)")
    assert {d: s for d, _, s in con.execute(lm_scoring.SQL).fetchall()} == got
