"""Prefix encodings under appends and edits, hashes that collide, decoding."""

import random

import numpy as np
import public_tokenizers
import pytest

from spheretiles.llm import bpe, pretokens

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(bpe.read_ranks(PATH))


def plain(v, piece):
    return [v.ranks[piece]] if piece in v.ranks else [v.ranks[x] for x in bpe.merged(piece, v.ranks)]


def test_appends_and_edits_are_exact(vocabulary):
    rng = random.Random(1)
    some = lambda n: bytes(rng.choice(b"abcdetrsing\xc3\xa9 ") for _ in range(rng.randrange(n)))
    e = bpe.PrefixEncoding(vocabulary, b"hello")
    for _ in range(300):
        at = rng.randrange(len(e.piece) + 1)
        e.append(some(6)) if rng.random() < 0.4 else e.edit(at, min(len(e.piece), at + rng.randrange(5)), some(6))
        assert e.ids() == plain(vocabulary, e.piece)


def test_an_edit_near_the_start_computes_few_prefixes(vocabulary):
    rng = random.Random(2)
    e = bpe.PrefixEncoding(vocabulary, bytes(rng.choice(b"abcdetrsing") for _ in range(3000)))
    e.edit(3, 4, b"zq")
    assert e.computed < 200 and e.ids() == plain(vocabulary, e.piece)
    e.append(b"ing")
    assert e.computed == 3 and e.ids() == plain(vocabulary, e.piece)


def test_pieces_whose_hashes_collide_keep_their_own_ids(vocabulary, monkeypatch):
    monkeypatch.setattr(pretokens, "_hashed", lambda data, starts, ends: (ends - starts).astype(np.uint64))
    seen = pretokens.Pieces(vocabulary.encode_pieces)
    text = b" good food hood wood said then when"
    for _ in range(2):
        ids, _ = seen.ids(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        assert ids.tolist() == [i for w in text.split() for i in plain(vocabulary, b" " + w)]


def test_a_full_cache_starts_anew(vocabulary):
    seen = pretokens.Pieces(vocabulary.encode_pieces, limit=200)
    for k in range(20):
        text = f"one{k} twofold{k} x".encode()
        ids, _ = seen.ids(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        assert vocabulary.decode(ids).tobytes() == text and seen.held() < 2000


def test_decode_gives_the_text_back(spark):
    texts = ["", None, "naïve 😀 text", "x" * 50, "same", "same"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ids = bpe.encode(docs, PATH)
    got = {r["doc_id"]: r for r in bpe.decode(ids, PATH).collect()}
    assert [bytes(got[i]["decoded"]).decode() for i in range(6)] == [t or "" for t in texts]
    assert {r["doc_id"]: bytes(r["decoded"]) for r in bpe.encode(docs, PATH, decoded=True).collect()} == {i: bytes(r["decoded"]) for i, r in got.items()}
    none = spark.createDataFrame([(1, 0, None)], "doc_id long, n_tokens long, ids binary")
    assert bpe.decode(none, PATH).first()["decoded"] is None
