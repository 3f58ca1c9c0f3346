"""Source divergence audit: how far the sources of each language use its terms differently, by one-hot level products.

The price of a term in a group follows from its count there alone, so a pair of groups needs no term, only how many terms
have count a in the one and b in the other: a joint table. With X the indicator matrix of terms by (group, count level), the
product of X transposed with X holds the joint tables of all pairs.

1. One map over texts counts terms by (lang, source) in slices; Spark adds them up, combined before the shuffle.
2. A language keeps the terms of at least `least` of its documents, found by a window over (lang, term).
3. Terms are dealt into blocks of about `TERMS` rows, groups into blocks of `COLUMNS`; a task gets a block of terms with a
   pair of group blocks. It sorts terms by their largest count, so that a product has few levels, and multiplies indicator
   columns in 32-bit floats: entries are counts of at most 4096 terms, so exact. Occupied cells are priced in 64-bit whole
   numbers and summed in two halves of 30 bits and more, so no sum overflows.
4. Terms in no group of either block have count 0 in both: they are priced in one go when blocks are summed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import documents, written
from .terms import LETTER, counted, runs
from .words import pieces, utf8

UNIT = 1_000_000_000
TERMS, COLUMNS, LEVELS, MOST = 8192, 32, 2048, 4096  # terms and groups of a block; levels and terms of a product
SALTS, HALF = 64, 30
INSIDE = LETTER.copy()
INSIDE[128:] = True


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and rows; each group also has a row with a null term and n = docs = 0."""

    def emit(batches):
        for batch in batches:
            for part in pieces(batch, limit=1 << 22):
                data, offsets = utf8(part.column("text"))
                terms, doc = runs(data, offsets, INSIDE[data])
                pairs = pa.StructArray.from_arrays([part.column("lang"), part.column("source")], ["lang", "source"]).to_pylist()
                known = {g: i for i, g in enumerate(dict.fromkeys((p["lang"], p["source"]) for p in pairs))}
                group = np.array([known[p["lang"], p["source"]] for p in pairs], np.int64)
                width = max(1, len(terms.dictionary))
                doc, code, times = counted(terms.indices.to_numpy(), doc, width)
                cell, place, held = np.unique(group[doc] * width + code, return_inverse=True, return_counts=True)
                n = np.bincount(place, times, len(cell)).astype(np.int64)
                of = np.append(cell // width, np.arange(len(known)))
                lang, source = (pa.array([g[k] for g in known], pa.string()) for k in (0, 1))
                none = np.zeros(len(known), np.int64)
                term = pa.concat_arrays([terms.dictionary.cast(pa.string()).take(pa.array(cell % width)), pa.nulls(len(known), pa.string())])
                yield pa.RecordBatch.from_arrays([lang.take(pa.array(of)), source.take(pa.array(of)), term, pa.array(np.append(n, none)), pa.array(np.append(held, none))], names=["lang", "source", "term", "n", "docs"])

    found = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]).mapInArrow(emit, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def price(count: Column, size: Column) -> Column:
    """1 + floor(UNIT * (count + 1) / size), exact: whole-number division of decimals."""
    wide = lambda c: c.cast("decimal(19,0)")
    return _div(wide(count + 1) * F.lit(UNIT).cast("decimal(10,0)"), wide(size)) + 1


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q) of prices, which stay below 2^30, so that the square fits."""
    return _div((p - q) * (p - q), q)


def prices(count: np.ndarray, size: np.ndarray) -> np.ndarray:
    """`price` of arrays: long division in three steps of 1000, for sizes below 9e15."""
    whole, rest = np.divmod(count + 1, size)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, size)
        whole = whole * 1000 + more
    return whole + 1


def _products(counts: np.ndarray, left: np.ndarray, right: np.ndarray, levels: int):
    """(a, b, times) of the occupied cells of each product's joint tables, and the (column, level) that a and b number.

    counts: terms by columns; left and right: the columns of the two group blocks; levels: about how many a product may have."""
    largest = counts.max(axis=1, initial=0)
    counts = counts[np.argsort(largest, kind="stable")]
    few = max(1, levels // max(1, counts.shape[1]))
    dense = int(np.searchsorted(np.sort(largest), few - 1, "right"))  # terms whose counts have fewer levels than a product may
    at = 0
    while at < len(counts):
        to = min(at + MOST, dense) if at < dense else at + few
        part = counts[at:to]
        sides = []
        for columns in (left, right):
            x, owner, level = [], [], []
            for c in columns.tolist():
                values, place = np.unique(part[:, c], return_inverse=True)
                one = np.zeros((len(part), len(values)), np.float32)
                one[np.arange(len(part)), place] = 1
                x.append(one)
                owner.append(np.full(len(values), c))
                level.append(values)
            sides.append((np.concatenate(x, axis=1), np.concatenate(owner), np.concatenate(level)))
        (x, *first), (y, *second) = sides
        joint = x.T @ y
        a, b = np.nonzero(joint)
        yield a, b, joint[a, b].astype(np.int64), first, second
        at = to


def _priced(lang: str, i: int, j: int, table: pa.Table, columns: int, levels: int) -> pa.Table:
    """(lang, g, h, high, low, seen): sums of the gaps of a block's terms, g's price against h's, for groups of blocks i and j."""
    heads = table.filter(pc.is_null(table.column("term")))
    place, size = heads.column("place").to_numpy(), heads.column("size").to_numpy()
    by = np.argsort(place)
    place, size = place[by], size[by]
    cells = table.filter(pc.is_valid(table.column("term")))
    terms = cells.column("term").combine_chunks().dictionary_encode()
    counts = np.zeros((len(terms.dictionary), len(place)), np.int64)
    counts[terms.indices.to_numpy(), np.searchsorted(place, cells.column("place").to_numpy())] = cells.column("n").to_numpy()
    left, right = np.flatnonzero(place // columns == i), np.flatnonzero(place // columns == j)
    high, low = np.zeros((2, len(place), len(place)), np.int64)
    for a, b, times, (of_a, level_a), (of_b, level_b) in _products(counts, left, right, levels):
        p, q = prices(level_a, size[of_a])[a], prices(level_b, size[of_b])[b]
        for g, h, x, y in [(of_a[a], of_b[b], p, q)] + ([(of_b[b], of_a[a], q, p)] if i != j else []):
            f = (x - y) * (x - y) // y
            np.add.at(high, (g, h), (f >> HALF) * times)
            np.add.at(low, (g, h), (f & ((1 << HALF) - 1)) * times)
    g, h = (x.ravel() for x in np.meshgrid(left, right, indexing="ij"))
    if i != j:
        g, h = np.concatenate([g, h]), np.concatenate([h, g])
    g, h = g[g != h], h[g != h]
    n = len(g)
    return pa.table([pa.array([lang] * n, pa.string()), pa.array(place[g]), pa.array(place[h]), pa.array(high[g, h]), pa.array(low[g, h]), pa.array(np.full(n, len(counts)))], names=["lang", "g", "h", "high", "low", "seen"])


def source_divergence(docs: DataFrame, least: int = 3, top: int = 200, terms: int = TERMS, columns: int = COLUMNS, levels: int = LEVELS) -> DataFrame:
    """(lang, source, part, item, value, rank) for every (lang, source) of `docs`, by the rules of the contract.

    part `pair`: each other source of the language and the sum of gap(p, q) over all kept terms, p and q the terms' prices in
    the group and in the other; part `term`: the kept terms with p above the price q in the whole language and their gap, ranks
    to `top`. Null text, lang or source is ''. Every row is a document, repeated ones too. A group without terms has pairs
    alone; a language without kept terms has values 0; an empty table gives an empty table. Other columns are not read.
    Counts of a group plus kept terms must stay below 9e15. terms, columns and levels size the blocks, not the result.
    """
    counts = written(term_counts(docs))
    term = Window.partitionBy("lang", "term")
    kept = counts.where("term is not null").select("lang", "source", "term", "n", F.sum("docs").over(term).alias("held"), F.sum("n").over(term).alias("total"), (F.min("source").over(term) == F.col("source")).cast("long").alias("once"))
    kept = written(kept.where(F.col("held") >= least).drop("held"))
    used = kept.groupBy("lang", "source").agg(F.sum("n").alias("size"), F.sum("once").alias("once"))
    whole = used.groupBy("lang").agg(F.sum("size").alias("lang_size"), F.sum("once").alias("terms"))
    groups = counts.where("term is null").select("lang", "source").join(used.drop("once"), ["lang", "source"], "left").join(whole, "lang", "left")
    groups = groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("terms", "size", "lang_size")])
    groups = groups.select("lang", "source", "terms", (F.col("size") + F.col("terms")).alias("size"), (F.col("lang_size") + F.col("terms")).alias("lang_size"), (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("long").alias("place"), F.count("*").over(Window.partitionBy("lang")).alias("groups"))
    groups = written(groups)
    return _pairs(kept, groups, terms, columns, levels).unionByName(_terms(kept, groups, top))


def _pairs(kept: DataFrame, groups: DataFrame, terms: int, columns: int, levels: int) -> DataFrame:
    def priced(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return _priced(*(k.as_py() for k in key[:3]), table, columns, levels)

    blocks = F.ceil(F.col("terms") / terms).cast("long")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("groups") - 1) / columns))).alias("other")
    own = F.floor(F.col("place") / columns)
    at = [F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")]
    cells = kept.join(groups, ["lang", "source"]).select("lang", F.pmod(F.xxhash64("term"), blocks).alias("block"), "term", "place", "n", "size", own.alias("own"), other)
    heads = groups.where("terms > 0").select("*", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("block"))
    heads = heads.select("lang", "block", F.lit(None).cast("string").alias("term"), "place", F.lit(0).cast("long").alias("n"), "size", own.alias("own"), other)
    rows = cells.unionByName(heads).select("lang", *at, "block", "term", "place", "n", "size")
    sums = rows.groupBy("lang", "i", "j", "block").applyInArrow(priced, "lang string, g long, h long, high long, low long, seen long")
    sums = sums.groupBy("lang", "g", "h").agg(F.sum("high").alias("high"), F.sum("low").alias("low"), F.sum("seen").alias("seen"))
    a = groups.select("lang", "source", F.col("place").alias("g"), F.col("size").alias("p_size"), "terms")
    b = groups.select("lang", F.col("source").alias("item"), F.col("place").alias("h"), F.col("size").alias("q_size"))
    unseen = gap(price(F.lit(0), F.col("p_size")), price(F.lit(0), F.col("q_size"))).cast("decimal(19,0)") * (F.col("terms") - F.col("seen")).cast("decimal(19,0)")
    value = F.col("high").cast("decimal(19,0)") * F.lit(1 << HALF).cast("decimal(10,0)") + F.col("low").cast("decimal(19,0)") + unseen
    pairs = a.join(b, "lang").where("g <> h").join(sums, ["lang", "g", "h"], "left").withColumn("value", F.when(F.col("terms") > 0, value).otherwise(0).cast("long"))
    return _ranked(pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value"), Window.partitionBy("lang", "source"))


def _terms(kept: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    priced = kept.join(groups, ["lang", "source"]).select("lang", "source", "term", price(F.col("n"), F.col("size")).alias("p"), price(F.col("total"), F.col("lang_size")).alias("q"))
    found = priced.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"), F.pmod(F.xxhash64("term"), F.lit(SALTS)).alias("salt"))
    # the first `top` of each salt hold the first `top` of the group, so that a hot source is not ranked in one task
    salted = _ranked(found, Window.partitionBy("lang", "source", "salt")).where(F.col("rank") <= top).drop("rank", "salt")
    return _ranked(salted, Window.partitionBy("lang", "source")).where(F.col("rank") <= top)


def _ranked(rows: DataFrame, groups) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(groups.orderBy(F.desc("value"), "item")))


def op11_source_divergence(spark, sf_dir: str) -> DataFrame:
    """Contract query: pairs of sources and terms of each source, priced against its language."""
    return source_divergence(documents(spark, sf_dir).select("text", "lang", "source"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT r, lang, source, unnest(ws) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY lang, source, term),
f AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER w + count(*) OVER w) AS p FROM f WINDOW w AS (PARTITION BY lang, source)),
l AS (SELECT lang, term, sum(n) AS n FROM f GROUP BY lang, term),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER w + count(*) OVER w) AS q FROM l WINDOW w AS (PARTITION BY lang)),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
 UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
z AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM u)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM z WHERE part = 'pair' OR rank <= 200
"""
