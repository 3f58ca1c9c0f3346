"""Line dedup: contract rows against brute force, batches against one batch, runs that are merged without a shuffle."""

import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from spheretiles.llm import line_dedup as L
from spheretiles.llm.tables import shared_folder

from . import brute

WHITE = "\x20\x09\x0a\x0b\x0c\x0d"


def plain(rows, least=5, chars=40):
    """(id, lines, dropped, digest) of every row."""
    key = lambda line: line.strip(WHITE).translate(brute.LOWER)
    holders = defaultdict(list)
    for d, t in rows:
        for k in {key(line) for line in (t or "").split("\n")}:
            holders[k].append(-1 if d is None else d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        gone = [len(key(x)) >= chars and len(holders[key(x)]) >= least and max(holders[key(x)]) != (-1 if d is None else d) for x in lines]
        kept = "\n".join(x for x, g in zip(lines, gone, strict=True) if not g)
        out.append((d, len(lines), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


LICENCE = "Permission is hereby granted, free of charge, to any person obtaining a copy"
ACCENTS = "é" * 40
ROWS = [
    (None, None), (None, LICENCE), (1, ""), (2, "\n\n"), (2, f"a\n{LICENCE}"), (3, f"\t{LICENCE.upper()} \r\nb\n{LICENCE}"), (4, LICENCE), (9, f"{LICENCE}\nlast\n{LICENCE}"), (9, f"{LICENCE}\nlast\n{LICENCE}"),
    *[(20 + i, f"{ACCENTS}\n{'é' * 39}\n{'É' * 40}\n own {i}") for i in range(6)],
    *[(40 + i, f"four rows hold this line of more than forty characters\n{i}") for i in range(4)],
    *[(50, "equal rows that hold this line of more than forty characters")] * 5,
    *[(None, "null ids alone hold this line of more than forty characters")] * 6,
    *[(60 + i, f"   {LICENCE} \n{'word ' * 30_000}\n{i}") for i in range(5)],
]


def got(df):
    return sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], hashlib.sha256(r["kept_text"].encode()).hexdigest()) for r in df.collect()), key=repr)


@pytest.mark.parametrize("batches", [1, 3, 7])
def test_lines_equal_brute_force(spark, monkeypatch, batches):
    monkeypatch.setattr(L, "SLICE", 20_000)
    docs = spark.createDataFrame([r + ("c",) * 4 for r in ROWS], "doc_id long, text string, h string, last string, kept_text string, size string")
    out = L.line_dedup(docs, batches=batches)
    assert out.columns == ["doc_id", "text", "h", "last", "size", "n_lines", "n_dropped", "kept_text"]
    assert got(out) == plain(ROWS)


def test_least_and_chars(spark):
    rows = [(i, f"short\n{LICENCE}") for i in range(3)]
    assert got(L.line_dedup(spark.createDataFrame(rows, "doc_id int, text string"), least=2, chars=1)) == plain(rows, 2, 1)


def test_empty_table(spark):
    assert L.line_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query_equals_brute_force(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, L.op13_line_dedup(spark, sf).collect()), key=repr) == plain(rows)


def keyed(spark, pairs):
    return spark.createDataFrame([(bytes([k] * 16), n, last) for k, n, last in pairs], "h binary, docs long, last long")


def batch(spark, b):
    return keyed(spark, [(k, 1 + (k * b) % 3, 100 * b + k) for k in range(b, 40, 1 + b % 4)])


def test_runs_hold_each_key_once_and_go_on_after_reopening(spark):
    folder = shared_folder(spark)
    runs, total, last = L.LineRuns(spark, folder, fanout=2, buckets=3), Counter(), {}
    for b in range(7):
        if b == 4:
            runs = L.LineRuns(spark, folder, fanout=2)  # what a later job sees
            assert runs.buckets == 3
        runs.add(batch(spark, b))
        for r in batch(spark, b).collect():
            total[bytes(r["h"])] += r["docs"]
            last[bytes(r["h"])] = max(r["last"], last.get(bytes(r["h"]), 0))
        assert all(len(level) < 2 for level in runs.levels)
        held = [bytes(r["h"]) for level in runs.levels for run in level for r in runs._table(run).collect()]
        assert len(held) == len(set(held)) == len(total)
    assert {bytes(r["h"]): (r["docs"], r["last"]) for r in runs.totals().collect()} == {k: (n, last[k]) for k, n in total.items()}


def test_a_batch_that_fails_leaves_the_runs_as_they_were(spark, monkeypatch):
    folder = shared_folder(spark)
    runs = L.LineRuns(spark, folder, fanout=2, buckets=2)
    runs.add(batch(spark, 0))
    before = sorted(map(repr, runs.totals().collect()))
    write, calls = L.LineRuns._write, []

    def broken(self, rows):
        calls.append(1)
        if len(calls) == 3:
            raise OSError("lost")
        return write(self, rows)

    monkeypatch.setattr(L.LineRuns, "_write", broken)
    with pytest.raises(OSError, match="lost"):
        runs.add(batch(spark, 1))
    monkeypatch.undo()
    assert sorted(map(repr, runs.totals().collect())) == before
    again = L.LineRuns(spark, folder, fanout=2)
    assert sorted(map(repr, again.totals().collect())) == before
    again.add(batch(spark, 1))
    assert again.totals().agg(F.sum("docs")).first()[0] == sum(r["docs"] for b in (0, 1) for r in batch(spark, b).collect())


def test_batches_meet_runs_without_a_shuffle(spark):
    runs = L.LineRuns(spark, shared_folder(spark), fanout=3, buckets=4)
    for b in range(2):
        runs.add(batch(spark, b))
    own = runs._table(runs._write(runs._dealt(batch(spark, 2))))
    plan = runs.unseen(own)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2 and "Exchange" not in plan
