"""Source divergence against brute force: blocks of terms and groups, empty groups, languages without kept terms."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from spheretiles.llm import divergence as D

from . import brute

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def plain(rows, least=3, top=200):
    """Rows of the contract for (text, lang, source)."""
    counts, docs, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = TERM.findall((text or "").translate(brute.LOWER))
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
        sources[lang].add(source)
    out = []
    for lang in sources:
        kept = [t for t, n in docs[lang].items() if n >= least]
        group = {s: Counter({t: counts[lang, s][t] for t in kept}) for s in sources[lang]}
        whole = Counter({t: sum(g[t] for g in group.values()) for t in kept})
        price = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}  # noqa: E731, B023
        p = {s: price(c) for s, c in group.items()}
        q = price(whole)
        gap = lambda a, b: (a - b) * (a - b) // b
        for s in group:
            pairs = [(sum(gap(p[s][t], p[o][t]) for t in kept), o) for o in group if o != s]
            terms = [(gap(p[s][t], q[t]), t) for t in kept if group[s][t] > 0 and p[s][t] > q[t]]
            for part, found, limit in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(found[:limit])]
    return sorted(out)


def made(seed=7):
    draw = random.Random(seed)
    words = [f"{a}{b}" for a in "abcdeé" for b in "xyzÄß"] + ["Ab", "aB", "日本", "n"]
    rows = [(None, "en", "s1"), ("", None, None), ("x1y x1y", None, "s2"), ("only here", "xx", "s1"), (None, "xx", "s9"), ("!?", "en", "empty")]
    for i in range(300):
        source = f"s{min(draw.randrange(12), 6 + i % 3)}"
        some = words[: draw.choice([4, 12, len(words)])]
        rows.append((" ,7".join(draw.choice(some) for _ in range(draw.choice([0, 3, 60]))), draw.choice(["en", "en", "de", ""]), source))
    return rows + rows[:40]  # repeated rows count each


def got(spark, rows, **more):
    docs = spark.createDataFrame([r + ("c",) * 3 for r in rows], "text string, lang string, source string, term string, n string, place string")
    return sorted(map(tuple, D.source_divergence(docs, **more).collect()))


@pytest.mark.parametrize("sizes", [{}, {"terms": 7, "columns": 2, "levels": 6}, {"terms": 1, "columns": 1, "levels": 1}])
def test_rows_equal_brute_force(spark, sizes):
    rows = made()
    assert got(spark, rows, **sizes) == plain(rows)


def test_ranks_end_at_top(spark):
    rows = made(8)
    assert got(spark, rows, top=3, least=2) == plain(rows, 2, 3)


def test_empty_table(spark):
    assert got(spark, []) == []


def test_long_text_of_one_term(spark):
    rows = [("z" * 200_000 + " a b", "en", f"s{i % 2}") for i in range(4)]
    assert got(spark, rows) == plain(rows)


def test_products_hold_every_term_once():
    counts = np.random.default_rng(1).geometric(0.02, (900, 5)) - 1
    for levels in (1, 40, 2048):
        seen = np.zeros((5, 5), np.int64)
        joint = Counter()
        for a, b, times, (of_a, level_a), (of_b, level_b) in D._products(counts, np.arange(3), np.arange(3, 5), levels):
            np.add.at(seen, (of_a[a], of_b[b]), times)
            for g, x, h, y, n in zip(of_a[a], level_a[a], of_b[b], level_b[b], times, strict=True):
                joint[g, x, h, y] += n
        assert (seen[:3, 3:] == 900).all()
        assert joint == Counter((g, r[g], h, r[h]) for r in counts for g in range(3) for h in (3, 4))


def test_prices_are_exact_for_large_counts():
    draw = random.Random(3)
    for _ in range(300):
        size = draw.randrange(1, 9 * 10**15)
        count = draw.randrange(size)
        assert D.prices(np.array([count]), np.array([size])).tolist() == [1 + 10**9 * (count + 1) // size]


def test_price_columns_are_exact(spark):
    pairs = [(0, 1), (10**15, 10**15 + 1), (123456789012, 987654321098765), (7, 9 * 10**15)]
    df = spark.createDataFrame(pairs, "c long, size long").select("c", "size", D.price(D.F.col("c"), D.F.col("size")).alias("p"))
    assert [(r["c"], r["size"]) for r in df.collect()] == pairs and all(r["p"] == 1 + 10**9 * (r["c"] + 1) // r["size"] for r in df.collect())
