"""Spelling variants against brute force: pairs of the composed acceptors, blocks, chains of forms, counting."""

import random
import re
import zlib
from collections import Counter

import pytest

from spheretiles.llm import spelling as S

from . import brute

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def counts(rows, least=5, chars=6):
    out = Counter()
    for d, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(brute.LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            out[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    return {w: n for w, n in out.items() if len(w) >= chars and n >= least}


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(words, ratio=5):
    """(word, n, n_near, form, form_n, root) of {word: n}."""
    found = {w: [v for v in words if near(w, v)] for w in words}
    form = {}
    for w, vs in found.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, words[w], len(found[w]), form[w], words.get(form[w]), root))
    return sorted(out)


def vocabulary(seed, size=250):
    draw = random.Random(seed)
    words = {}
    while len(words) < size:
        base = draw.choice(sorted(words)) if words and draw.random() < 0.7 else "".join(draw.choice("abé") for _ in range(draw.randrange(6, 11)))
        at = draw.randrange(len(base))
        w = draw.choice([base, base[:at] + draw.choice("abcé") + base[at:], base[:at] + base[at + 1 :], base[:at] + draw.choice("abcé") + base[at + 1 :]])
        if len(w) >= 6:
            words[w] = draw.choice([5, 6, 25, 30, 130, 700, 4000])
    return words


def got(df):
    return sorted((r["word"], r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in df.collect())


@pytest.mark.parametrize("seed", range(3))
def test_groups_equal_brute_force(spark, seed):
    words = vocabulary(seed)
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert got(S.spelling_groups(df)) == plain(words)


def test_pairs_do_not_depend_on_blocks(spark):
    words = vocabulary(9)
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    want = sorted((u, v, words[v]) for u in words for v in words if near(u, v))
    for most in (1, 3, 8192):
        assert sorted(map(tuple, S.near_words(df, most=most).collect())) == want


def test_chain_of_forms(spark):
    words = {"aaaaaa" + "b" * i: 5 * 6**i for i in range(13)}
    assert got(S.spelling_groups(spark.createDataFrame(list(words.items()), "word string, n long"))) == plain(words)
    with pytest.raises(ValueError, match="ratio"):
        S.spelling_groups(spark.createDataFrame([], "word string, n long"), ratio=1)


@pytest.mark.parametrize("seed", range(20))
def test_acceptor_pairs(seed):
    draw = random.Random(seed)
    strings = sorted({"".join(draw.choice("ab") for _ in range(draw.randrange(0, 7))) for _ in range(40)})
    found = [tuple(sorted(p)) for p in S.Acceptor(strings).near_pairs()]
    assert len(found) == len(set(found)) and set(found) == {(a, b) for a in strings for b in strings if a < b and near(a, b)}


def test_acceptor_is_minimal():
    machine = S.Acceptor(sorted(a + b + "ing" for a in "abc" for b in "xyz"))
    assert len(machine.arcs) == 6  # one state after each code point
    long = "a" * 30_000
    assert list(S.Acceptor([long, long + "b"]).near_pairs()) == [(long + "b", long)]
    assert list(S.Acceptor([long, long + "a"]).near_pairs()) == [(long + "a", long)]


TEXTS = [
    (None, None), (None, "Straße straße"), (1, ""), (2, "!? 12"), (3, "É×÷ÿ" * 4 + " " + "É×÷ÿ" * 4), (4, "word" * 8000), (4, "word" * 8000),
    *[(i, f"letters lettera lettersé Letters ĀlettersĀ {'abcdef' + 'ghijk'[i % 5]} naïveté " * (1 + i % 4)) for i in range(400)],
]


def test_counts_equal_brute_force(spark):
    docs = spark.createDataFrame([r + ("c", "c") for r in TEXTS * 2], "doc_id long, text string, word string, n string")
    words = {r["word"]: r["n"] for r in S.word_counts(docs).collect() if r["n"] >= 5}
    assert words == counts(TEXTS * 2) and len(words) > 10
    assert got(S.spelling_variants(docs)) == plain(words)


def test_empty_tables(spark):
    assert S.spelling_variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert S.spelling_variants(spark.createDataFrame([(1, None), (None, "")], "doc_id long, text string")).collect() == []


def test_query_equals_brute_force(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got(S.op12_spelling_variants(spark, sf)) == plain(counts(rows))
