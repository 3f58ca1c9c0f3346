"""Spelling variant grouping: the vocabulary's minimal acceptor composed with a one-edit transducer and itself.

Words u and v are near if the machine A o E o A accepts the pair: A reads u, E copies with exactly one inserted, deleted or
replaced code point, A reads v. Of a near pair let m be the shorter length and s = m // 2. Either the edit comes after s code
points, and both words reach the same state of A after s arcs; or it comes before, and both share their last m - s ones, a
state of the reversed machine. So pairs are enumerated in one partition for each such state, which words of lengths m and
m + 1 share:

1. One map over texts counts words in slices; Spark adds them up, combined before the shuffle.
2. A word goes to four partitions: m its own length or one less, by its first s or its last m - s code points. Partitions of
   one word have no pair. One of more than `MOST` words is cut into blocks, and each pair of blocks meets once.
3. A task builds the minimal acceptor of what the words do not share (heads or tails) and follows the composed machine: before
   the edit both sides are in one state; after it, a pair of states accepts what both accept. Pairs of the reversed machine
   that share their first s code points too are left to the other.
4. The form of a word is its best near word; roots come from doubling the chain of forms, which is short, as n grows along it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import documents, whole_groups, written
from .terms import LETTER, counted, runs
from .words import pieces, utf8

MOST = 8192
FIRST_BYTE = 0xC3  # of the two bytes of U+00C0 to U+00FF, and of no other code point


def word_counts(docs: DataFrame, id: str = "doc_id", text: str = "text", chars: int = 6, every: int = 199) -> DataFrame:
    """(word, n): occurrences of the runs of letters of all texts; where `every` divides the CRC of id and run, one is deleted."""

    def emit(batches):
        for batch in batches:
            for part in pieces(batch, limit=1 << 22):
                data, offsets = utf8(part.column("text"))
                first = data == FIRST_BYTE
                inside = LETTER[data] | first
                inside[1:] |= first[:-1]
                words, doc = runs(data, offsets, inside)
                strings = words.dictionary.to_pylist()
                doc, code, times = counted(words.indices.to_numpy(), doc, max(1, len(strings)))
                begin = [zlib.crc32(f"{i}:".encode()) for i in part.column("id").to_pylist()]
                raw = [s.encode() for s in strings]
                crc = np.array([zlib.crc32(raw[c], begin[d]) for d, c in zip(doc.tolist(), code.tolist(), strict=True)], np.int64)
                hit = crc % every == 0
                n = np.bincount(code[~hit], times[~hit], len(strings)).astype(np.int64)
                size = pc.utf8_length(words.dictionary).to_numpy(zero_copy_only=False)
                keep = np.flatnonzero((n > 0) & (size >= chars))
                cut, cut_n = [], []
                for c, h, k in zip(code[hit].tolist(), crc[hit].tolist(), times[hit].tolist(), strict=True):
                    if size[c] > chars:
                        at = h % len(strings[c])
                        cut.append(strings[c][:at] + strings[c][at + 1 :])
                        cut_n.append(k)
                word = pa.concat_arrays([words.dictionary.take(pa.array(keep)).cast(pa.string()), pa.array(cut, pa.string())])
                yield pa.RecordBatch.from_arrays([word, pa.array(np.append(n[keep], np.array(cut_n, np.int64)))], names=["word", "n"])

    own = docs.select(F.coalesce(F.col(id).cast("string"), F.lit("")).alias("id"), F.col(text).alias("text"))
    return own.mapInArrow(emit, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Acceptor:
    """The minimal deterministic acceptor of sorted distinct strings: `arcs` and `final` of each state, `start`."""

    def __init__(self, strings: list[str]):
        self.arcs: list[dict[str, int]] = []
        self.final: list[bool] = []
        known: dict[tuple, int] = {}
        path: list[list] = [[False, []]]  # states of the last string that may still get arcs
        last = ""

        def close(depth: int) -> None:
            while len(path) > depth + 1:
                final, arcs = path.pop()
                state = known.setdefault((final, tuple(arcs)), len(self.arcs))
                if state == len(self.arcs):
                    self.arcs.append(dict(arcs))
                    self.final.append(final)
                path[-1][1].append((last[len(path) - 1], state))

        for s in strings:
            same = len(commonprefix((last, s)))
            close(same)
            path.extend([False, []] for _ in s[same:])
            path[-1][0] = True
            last = s
        close(0)
        self.start = len(self.arcs)
        self.arcs.append(dict(path[0][1]))
        self.final.append(path[0][0])
        self._common: dict[tuple[int, int, str], list[str]] = {}

    def common(self, a: int, b: int, but: str = "") -> list[str]:
        """What states a and b both accept, save what begins with `but`: the composed machine after the edit."""
        out = self._common.get((a, b, but))
        if out is None:
            out, todo = [], [(a, b, "")]
            while todo:
                x, y, read = todo.pop()
                if self.final[x] and self.final[y]:
                    out.append(read)
                other = self.arcs[y]
                todo.extend((to, other[c], read + c) for c, to in self.arcs[x].items() if c in other and (read or c != but))
            self._common[a, b, but] = out
        return out

    def edits(self, state: int) -> list[tuple[str, str]]:
        """Pairs of strings accepted from `state` that differ by an edit of their first code point.

        A code point inserted into a run of its like counts at the end of the run alone, so no pair comes twice.
        """
        arcs = list(self.arcs[state].items())
        out = [(x + rest, y + rest) for i, (x, a) in enumerate(arcs) for y, b in arcs[i + 1 :] for rest in self.common(a, b)]
        return out + [(x + rest, rest) for x, a in arcs for rest in self.common(a, state, x)]

    def near_pairs(self) -> Iterator[tuple[str, str]]:
        """Accepted pairs one edit apart, each once, in either order."""
        found, todo = {}, [(self.start, "")]
        while todo:
            state, read = todo.pop()
            if state not in found:
                found[state] = self.edits(state)
            yield from ((read + a, read + b) for a, b in found[state])
            todo.extend((to, read + c) for c, to in self.arcs[state].items())


def _near(tail: bool, m: int, i: int, j: int, rows: list[tuple[str, int, int]]):
    """(word, near, n of near) of one partition, in both directions; rows: (word, n, block)."""
    s = m // 2
    strip = (lambda w: w[s:]) if tail else (lambda w: w[: len(w) - (m - s)])
    known = {strip(w): (w, n, own) for w, n, own in rows}
    least = m - s if tail else s
    for a, b in Acceptor(sorted(known)).near_pairs():
        if min(len(a), len(b)) != least or not tail and a[:s] == b[:s]:
            continue
        (u, n_u, of_u), (v, n_v, of_v) = known[a], known[b]
        if {of_u, of_v} == {i, j}:
            yield u, v, n_v
            yield v, u, n_u


def near_words(words: DataFrame, chars: int = 6, most: int = MOST) -> DataFrame:
    """(word, near, near_n): both directions of every pair of `words` (word, n; each word once) one edit apart.

    `most` words make a block; the result does not depend on it.
    """
    size, s = F.length("word"), F.floor(F.col("m") / 2).cast("int")
    at = words.where(size >= chars).select("*", F.explode(F.filter(F.array(size, size - 1), lambda m: m >= chars)).alias("m"))
    at = at.select("*", F.explode(F.array(F.lit(True), F.lit(False))).alias("tail"))
    at = at.withColumn("shared", F.when(F.col("tail"), F.expr("left(word, m div 2)")).otherwise(F.expr("right(word, m - m div 2)")))
    at = written(at)
    state = ["tail", "m", "shared"]
    sizes = at.groupBy(*state).agg(F.ceil(F.count("*") / most).alias("blocks"), F.count("*").alias("size")).where("size > 1").drop("size")
    dealt = at.join(sizes, state).withColumn("own", F.pmod(F.xxhash64("word"), "blocks"))
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("word", "n", *state, "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    dealt = dealt.withColumn("key", F.xxhash64(*state, "i", "j"))

    def find(batches):
        for table in whole_groups(batches, ["key"]):
            groups: dict[tuple, list] = {}
            for tail, m, shared, i, j, word, n, own in zip(*[table.column(c).to_pylist() for c in (*state, "i", "j", "word", "n", "own")], strict=True):
                groups.setdefault((tail, m, shared, i, j), []).append((word, n, own))
            found = [x for (tail, m, _, i, j), rows in groups.items() for x in _near(tail, m, i, j, rows)]
            u, v, n = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.string()), pa.array(v, pa.string()), pa.array(n, pa.int64())], names=["word", "near", "near_n"])

    return dealt.repartition("key").sortWithinPartitions("key").mapInArrow(find, "word string, near string, near_n long")


def spelling_groups(words: DataFrame, ratio: int = 5, chars: int = 6) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of `words` (word, n): the groups of spelling variants.

    A word's form is its near word of largest n (ties: smallest in code-point order), if that is `ratio` times the word's n or
    more (2 at least); its root is the last of the chain of forms, the word itself if it has none. Words below `chars` code
    points, or null, are left out; an empty table gives an empty table. Each word must come once.
    """
    if ratio < 2:
        raise ValueError("ratio: 2 at least, so that chains end")
    near = near_words(words, chars).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    best = words.where(F.length("word") >= chars).join(near, "word", "left")
    has = -F.col("best.less") >= ratio * F.col("n")
    out = written(best.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("best.near")).alias("form"), F.when(has, -F.col("best.less")).alias("form_n")))
    chain = written(out.where("form is not null").select("word", F.col("form").alias("root")))
    for _ in range(6):  # n at least doubles along a link, so a chain has at most 62 links
        step = chain.join(chain.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left")
        step = written(step.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        chain = step.drop("moved")
        if step.where("moved").isEmpty():
            break
    return out.join(chain, "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(docs: DataFrame, id: str = "doc_id", text: str = "text", least: int = 5, ratio: int = 5, chars: int = 6) -> DataFrame:
    """Spelling groups of the words of `docs` with `chars` code points or more and `least` occurrences or more.

    A null or empty text has no words; a null id counts as ''; repeated rows count each; other columns are not read.
    """
    return spelling_groups(written(word_counts(docs, id, text, chars).where(F.col("n") >= least)), ratio, chars)


def op12_spelling_variants(spark, sf_dir: str) -> DataFrame:
    """Contract query: words, their near words, forms and roots."""
    return spelling_variants(documents(spark, sf_dir))


SQL = r"""
WITH RECURSIVE r AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents),
c AS (SELECT doc_id, run, count(*) AS n FROM r GROUP BY doc_id, run HAVING length(run) >= 6),
b AS (SELECT *, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]
  ELSE [195::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1, unicode(x)::BIGINT - 64, -1, -1, -1, -1, -1, -1, -1, -1] END)) AS steps FROM c),
h AS (SELECT run, n, xor(4294967295::BIGINT, list_reduce(list_concat([4294967295::BIGINT], steps), lambda crc, x: CASE WHEN x >= 0 THEN xor(crc, x) WHEN crc & 1 = 1 THEN xor(crc >> 1, 3988292384::BIGINT) ELSE crc >> 1 END)) AS crc FROM b),
e AS (SELECT CASE WHEN crc % 199 = 0 THEN substr(run, 1, crc % length(run)) || substr(run, crc % length(run) + 2) ELSE run END AS word, n FROM h),
w AS (SELECT word, sum(n)::BIGINT AS n FROM e WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
d AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM w, LATERAL (SELECT unnest(range(1, length(word) + 1)) AS i)),
p AS (SELECT a.word, b.word AS near FROM d a JOIN d b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
 UNION SELECT d.word, w.word FROM d JOIN w ON d.rest = w.word UNION SELECT w.word, d.word FROM d JOIN w ON d.rest = w.word),
m AS (SELECT p.word, count(*) AS n_near, arg_min(near, (-w.n, near)) AS near, max(w.n) AS near_n FROM p JOIN w ON w.word = p.near GROUP BY p.word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * w.n THEN near END AS form, CASE WHEN near_n >= 5 * w.n THEN near_n END AS form_n FROM w LEFT JOIN m USING (word)),
t AS (SELECT word, word AS at FROM f UNION ALL SELECT t.word, f.form FROM t JOIN f ON f.word = t.at WHERE f.form IS NOT NULL),
z AS (SELECT t.word, t.at AS root FROM t JOIN f ON f.word = t.at WHERE f.form IS NULL)
SELECT f.word, n, n_near, form, form_n, root FROM f JOIN z ON z.word = f.word
"""
