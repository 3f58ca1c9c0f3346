"""Near-dedup of rows that are repeated in full, share an id or have none."""

import corpus_pipeline as P

TEXT = {k: " ".join(f"{k}{i}" for i in range(60)) for k in "abcde"}
ROWS = [
    (5, TEXT["a"]), (5, TEXT["a"]), (9, TEXT["a"]),  # repeated in full
    (None, TEXT["b"]), (7, TEXT["b"]),  # null id beside an id
    (None, TEXT["c"]), (None, TEXT["c"]), (None, TEXT["c"] + " more"),  # null ids alone
    (8, TEXT["d"]), (8, TEXT["e"]), (8, TEXT["e"]),  # one id, different texts
    (None, None), (None, ""), (3, None),
]


def test_one_row_of_each_group_stays(spark, sf):
    docs = spark.createDataFrame([(d, t, "en", "s", 0 if t is None else len(t)) for d, t in ROWS], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [(r["doc_id"], r["text"]) for r in P.drop_near_copies(spark, docs, sf).collect()]
    of = lambda k: [d for d, t in kept if t and t.startswith(f"{k}0 ")]
    assert of("a") == [5] and of("b") == [7] and of("c") == [None] and of("d") == [8] and of("e") == [8]
    assert len([t for _, t in kept if not t]) == 3 and len(kept) == 8
