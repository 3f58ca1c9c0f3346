"""Contract queries against brute force on the given small tables, and against planted hard rows."""

import base64
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import types as T

from spheretiles.llm import bpe, embedding_dedup, lm_scoring, minhash_dedup, packing, pii, quality, queries, substring_dedup, toxicity, vector_search

from . import brute

HARD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "one two"), (6, "é 😀 naïve ｆｕｌｌ space\x0bend\r\n"),
    (7, "mail a.b%c@x-y.co.uk, not a@b; ip 10.0.0.255 1.2.3.256 1.2.3.4.5; card 4111 1111 1111 1111, 4111-1111-1111-1112; call +1 (555) 010-9999 or +12"),
    (8, "😀😀 write joe (at) example [dot] com or 192[.]168[.]0[.]1 and 4111  1111  1111  1111 and 555-010-9999"),
    (9, " ".join(f"w{i % 50}" for i in range(200))), (10, " ".join(f"w{i}" for i in range(3000))), (11, " ".join(f"w{i}" for i in range(3000)) + " tail"),
    (12, "a" * 5000 + "@" + "b" * 10), (13, "1" * 4000), (14, "<|endoftext|> [INST] 1234567 don't  STOP"), (15, "same text here for all of them " * 30), (16, "same text here for all of them " * 30),
]
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n", T.LongType()), T.StructField("row", T.StringType())])


@pytest.fixture(scope="module", params=["table", "hard", "empty"])
def docs(request, spark, sf):
    """A DataFrame of documents and the same as a dict; the made-up ones carry columns whose names clash."""
    if request.param == "table":
        df = spark.read.parquet(f"{sf}/documents.parquet")
    else:
        df = spark.createDataFrame([(i, t, i, "x") for i, t in HARD] if request.param == "hard" else [], DOCS)
    return df, {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


@pytest.fixture
def over(monkeypatch):
    """Lets a query read given tables."""

    def put(module, **tables):
        monkeypatch.setattr(module, "documents", lambda spark, sf, table="documents": tables[table])

    return put


def labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet")


def rows(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_pii(spark, docs, over, sf):
    over(pii, documents=docs[0])
    got = rows(pii.op1_pii(spark, sf))
    assert set(got) == set(docs[1])
    for d, text in docs[1].items():
        base = brute.base_spans(text or "")
        for kind in ("email", "ip", "card", "phone"):
            assert got[d][f"n_{kind}"] == sum(b[0] == kind for b in base), (d, kind)
        joined = [f"{k}:{s}:{e}" for k, s, e in base]
        assert got[d]["base_sha256"] == brute.sha(",".join(joined).encode()), (d, base, got[d]["spans"])
        assert set(joined) <= set(got[d]["spans"].split(",")) | {""}


def test_packing(spark, docs, over, sf):
    from tokenizers import Tokenizer

    over(packing, documents=docs[0])
    got = packing.op2_best_fit_packing(spark, sf).collect()
    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    # as the contract says, nothing but add_special_tokens is set: a special token's string in a text is that token
    ids = {d: [*coder.encode(t or "", add_special_tokens=False).ids, 2] for d, t in docs[1].items()}
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(ids)
    for d, parts in by_doc.items():
        at = 0
        for k, r in enumerate(sorted(parts, key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (k, at)
            piece = np.asarray(ids[d][at : at + r["length"]], "<u4")
            assert r["ids_crc32"] == zlib.crc32(piece.tobytes())
            assert len(ids[d]) > 1024 or len(parts) == 1
            assert k == 0 or r["length"] == 1024 or k == len(parts) - 1
            at += r["length"]
        assert at == len(ids[d])
    for parts in by_seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    total = sum(map(len, ids.values()))
    if total > 50_000:
        assert len(by_seq) <= 1.05 * -(-total // 1024)


def test_quality(spark, docs, over, sf):
    over(quality, documents=docs[0], labels=labels(spark, sf))
    got = quality.op3_quality_resampling(spark, sf).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(docs[1])
    assert brute.gumbel_ok(got)


def test_bpe(spark, docs, over, sf):
    import tiktoken

    over(bpe, documents=docs[0])
    got = rows(bpe.op4_byte_bpe(spark, sf))
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert set(got) == set(docs[1])
    for d, text in docs[1].items():
        ids = coder.encode_ordinary(text or "")
        assert got[d]["n_tokens"] == len(ids), d
        assert got[d]["ids_sha256"] == brute.sha(np.asarray(ids, "<u4").tobytes()), d
        assert got[d]["decoded_sha256"] == brute.sha((text or "").encode()), d




def test_embedding_dedup(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    vec = next(f.name for f in table.schema.fields if isinstance(f.dataType, T.ArrayType))
    data = [(r["vec_id"], r[vec], r["label"]) for r in table.collect()]
    links = brute.embedding_links(data)
    comp = brute.components([i for i, _, _ in data], links)
    degree = {i: 0 for i in comp}
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    got = rows(embedding_dedup.op5_embedding_dedup(spark, sf), "vec_id")
    assert {i: (r["n_links"], r["component_id"], r["kept"]) for i, r in got.items()} == {i: (degree[i], comp[i], comp[i] == i) for i in comp}


def test_vector_search(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    vec = next(f.name for f in table.schema.fields if isinstance(f.dataType, T.ArrayType))
    data = {r["vec_id"]: np.asarray(r[vec], np.float64) for r in table.collect() if r[vec] is not None and all(x is not None for x in r[vec])}
    data = {i: v for i, v in data.items() if np.isfinite(v).all() and v.any()}
    got = {}
    for r in vector_search.op6_vector_search(spark, sf).collect():
        got.setdefault(r["query_id"], []).append(r)
    assert set(got) == {i for i in data if i % 100 == 0}
    hits = total = 0
    for q, found in got.items():
        found.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in found] == list(range(1, len(found) + 1))
        for r in found:
            assert abs(r["score"] - np.linalg.norm(data[q] - data[r["vec_id"]])) < 1e-9
        best = sorted((float(np.linalg.norm(data[q] - v)), i) for i, v in data.items() if i != q)[:10]
        hits += len({i for _, i in best} & {r["vec_id"] for r in found})
        total += len(best)
    assert hits >= 0.9 * total


def test_lm_scoring(spark, docs, over, sf):
    over(lm_scoring, documents=docs[0])
    got = rows(lm_scoring.op7_lm_scoring(spark, sf))
    documents = docs[0].select("doc_id", "text").toPandas()  # noqa: F841 (read by DuckDB)
    documents = documents.astype({"doc_id": "int64"})
    con = duckdb.connect()
    con.register("documents", documents)
    want = {} if documents.empty else {d: (n, s) for d, n, s in con.execute(f"SELECT doc_id, n_words, lm_score FROM ({lm_scoring.SQL})").fetchall()}
    assert set(got) == set(want)
    for d, (n, s) in want.items():
        assert got[d]["n_words"] == n
        assert (s is None) == (got[d]["lm_score"] is None)
        assert s is None or abs(got[d]["lm_score"] - s) < 2e-6


def test_toxicity(spark, docs, over, sf):
    over(toxicity, documents=docs[0], labels=labels(spark, sf))
    got = rows(toxicity.op8_toxicity(spark, sf))
    assert set(got) == set(docs[1])
    for d, r in got.items():
        assert r["held_out"] == brute.held_out(d) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["toxic"] for r in labels(spark, sf).collect() if r["toxic"] is not None}
    pairs = [(r["score"], truth[r["doc_id"]]) for r in toxicity.op8_toxicity(spark, sf).collect() if r["held_out"] and r["doc_id"] in truth]
    yes, no = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    auc = sum((a > b) + (a == b) / 2 for a in yes for b in no) / max(1, len(yes) * len(no))
    assert auc >= 0.9, (auc, len(yes), len(no))


def test_substring_dedup(spark, docs, over, sf):
    over(substring_dedup, documents=docs[0])
    got = rows(substring_dedup.op9_substring_dedup(spark, sf))
    assert {d: (r["n_words"], r["n_removed"], r["kept_sha256"]) for d, r in got.items()} == brute.repeats(docs[1])


def test_minhash_dedup(spark, docs, over, sf):
    over(minhash_dedup, documents=docs[0])
    got = rows(minhash_dedup.op10_minhash_dedup(spark, sf))
    assert {d: (r["n_shingles"], r["component_id"], r["kept"]) for d, r in got.items()} == brute.near_duplicates(docs[1])


def test_ten_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))
