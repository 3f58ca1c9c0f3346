"""Dedup and search of vectors on hard rows: lengths, ties, copies, nulls, repeated ids; recall of the scan alone."""

import numpy as np
import pytest

from spheretiles.llm import embedding_dedup, vector_search

from . import brute

SCHEMA = "vec_id long, embedding array<double>, label string, block int, part int"
UNUSABLE = [None, [], [0.0, 0.0], [1.0, None], [float("nan"), 1.0], [float("inf"), 1.0]]


def rows_of(spark, data):
    return spark.createDataFrame([(i, v, y, 7, 7) for i, v, y in data], SCHEMA)


def hard():
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 6))
    data = [(i, list(map(float, v)), "a" if i % 2 else "b") for i, v in enumerate(base)]
    data += [(100 + i, list(map(float, v + 0.05 * rng.normal(size=6))), "a" if i % 2 else "b") for i, v in enumerate(base)]
    data += [(200 + i, [1.0, 2.0, 0.5 * (i % 3)], "a") for i in range(12)]  # another length, with copies
    data += [(300 + i, v, "a") for i, v in enumerate(UNUSABLE)] + [(400, [1.0, 2.0], None), (401, [1.0, 2.0], "a"), (402, [-0.0, 1.0], "a"), (403, [0.0, 1.0], "a")]
    return data


def test_dedup_of_hard_rows(spark):
    data = hard()
    links = [(a, b) for a, b in brute.embedding_links([(i, v, (y, len(v or []))if y else None) for i, v, y in data])]
    degree, comp = {i: 0 for i, _, _ in data}, brute.components([i for i, _, _ in data], links)
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.embedding_links(rows_of(spark, data)).collect()}
    assert got == {i: (degree[i], comp[i], comp[i] == i) for i in comp}


def test_dedup_of_repeated_rows_and_null_ids(spark):
    v, w = [1.0, 0.0, 0.2], [0.0, 1.0, 0.1]
    data = [(1, v, "a"), (1, v, "a"), (1, w, "a"), (2, w, "a"), (None, v, "a")]
    got = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0, r["kept"]) for r in embedding_dedup.embedding_links(rows_of(spark, data)).collect())
    assert got == [(0, 0, 0, True), (1, 1, 1, True), (1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False)]
    assert embedding_dedup.embedding_links(rows_of(spark, [])).count() == 0


def test_learned_rotations_balance_bits():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 32)) * np.linspace(0.2, 2, 32) + 3
    mean, r = embedding_dedup.learned(x, 64)
    bits = (embedding_dedup.units(x) - mean) @ r > 0
    assert r.shape == (32, 64) and np.abs(bits.mean(axis=0) - 0.5).max() < 0.15
    assert np.allclose(r[:, :32].T @ r[:, :32], np.eye(32), atol=1e-8)


def brute_nearest(data, queries, k):
    good = [(i, np.array(v)) for i, v, _ in data if i is not None and v and all(x is not None for x in v) and np.isfinite(v).all() and np.any(v)]
    out = {}
    for q, x in good:
        if q in queries:
            out[q] = sorted((float(np.sqrt(((x - y) ** 2).sum())), i) for i, y in good if i != q and len(x) == len(y))[:k]
    return out


def test_search_of_hard_rows(spark):
    data = hard()
    ids = {i for i, _, _ in data if i % 3 == 0}
    vectors = rows_of(spark, data)
    found = {}
    for r in vector_search.nearest(vectors, vectors.where("vec_id % 3 = 0"), k=7).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    want = brute_nearest(data, ids, 7)
    assert {q: [i for _, i in f] for q, f in found.items()} == {q: [i for _, i in w] for q, w in want.items() if w}
    assert vector_search.nearest(rows_of(spark, []), rows_of(spark, [])).count() == 0


def test_ties_of_thousands_of_copies_go_to_the_smallest_ids(spark):
    rng = np.random.default_rng(2)
    data = [(i, list(map(float, rng.normal(size=8))), "a") for i in range(1000)]
    data += [(100_000 + i, data[0][1], "a") for i in reversed(range(2000))]
    vectors = rows_of(spark, data)
    got = vector_search.nearest(vectors, vectors.where("vec_id = 0")).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == list(range(100_000, 100_010)) and {r["score"] for r in got} == {0.0}


@pytest.mark.parametrize("clusters", [None, 50])
def test_recall_of_the_scan_at_fifty_thousand_rows(clusters):
    rng = np.random.default_rng(4)
    n, d, part, rerank = 50_000, 64, 8192, 256
    x = rng.normal(size=(n, d)) if clusters is None else rng.normal(size=(clusters, d))[rng.integers(0, clusters, n)] + 0.4 * rng.normal(size=(n, d))
    q = x[::1000]
    book = vector_search.Codebook(x[rng.permutation(n)[:8192]])
    hits = 0
    exact = ((x[None] - q[:, None]) ** 2).sum(axis=2) if n * len(q) * d < 2e8 else np.stack([((x - r) ** 2).sum(axis=1) for r in q])
    best = np.argsort(exact, axis=1)[:, 1:11]
    for at in range(0, n, part):
        y = x[at : at + part]
        got = at + vector_search._scanned(vector_search.packed(book.encode(y)), (y**2).sum(axis=1) / 2, q, book, min(rerank, len(y) - 1))
        hits += sum(len(set(b) & set(g)) for b, g in zip(best.tolist(), got.tolist(), strict=True))
    recall = hits / best.size
    print("recall", clusters, recall)
    assert recall >= 0.95
