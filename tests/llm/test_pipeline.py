"""Every stage of the corpus pipeline against brute force on what its predecessor kept, on a small given table."""

import corpus_pipeline as P
import pytest
from spheretiles.llm.tables import documents, written

from . import brute


@pytest.fixture(scope="module")
def chain(spark, sf):
    """[(name, rows before, rows after)] of the stages; rows are dicts by doc_id, of the last a list."""
    docs, out = documents(spark, sf), []
    by_id = lambda df: {r["doc_id"]: r.asDict() for r in df.collect()}
    for name, stage in P.STAGES[:-1]:
        after = written(stage(spark, docs, sf))
        assert sorted(after.columns) == sorted(P.COLUMNS)
        out.append((name, by_id(docs), by_id(after)))
        assert after.count() == len(out[-1][2])
        docs = after
    name, stage = P.STAGES[-1]
    return [*out, (name, by_id(docs), stage(spark, docs, sf).collect())]


def test_order():
    assert [f.__name__ for _, f in P.STAGES] == ["drop_toxic", "drop_near_copies", "cut_repeats", "redact", "pack"]


def test_toxic_documents_go_and_clean_ones_stay(spark, sf, chain):
    _, before, after = chain[0]
    marked = {r["doc_id"]: r["toxic"] for r in documents(spark, sf, "labels").collect() if r["doc_id"] in before and r["toxic"] is not None}
    gone = set(before) - set(after)
    assert all(before[d] == after[d] for d in after)
    toxic, clean = [d for d, y in marked.items() if y], [d for d, y in marked.items() if not y]
    assert sum(d in gone for d in toxic) >= 0.9 * len(toxic)
    assert sum(d in gone for d in clean) <= 0.05 * len(clean)


def test_one_of_each_group_stays(chain):
    _, before, after = chain[1]
    found = brute.near_duplicates({d: r["text"] for d, r in before.items()}, 80)
    assert set(after) == {d for d, (_, _, kept) in found.items() if kept}
    assert all(before[d] == after[d] for d in after)


def test_repeats_are_cut(chain):
    _, before, after = chain[2]
    assert set(before) == set(after)
    for d, (_, removed, sha) in brute.repeats({d: r["text"] for d, r in before.items()}).items():
        if removed:
            assert brute.sha(after[d]["text"].encode()) == sha and after[d]["n_chars"] == len(after[d]["text"])
        else:
            assert after[d]["text"] == before[d]["text"]


def test_personal_data_is_redacted(chain):
    _, before, after = chain[3]
    assert set(before) == set(after)
    for d, r in before.items():
        text, out = r["text"] or "", after[d]["text"] or ""
        spans = brute.base_spans(text)
        assert all(text[s:e] not in out for _, s, e in spans), d
        assert spans == [] or out != text


def test_pieces_are_gapless(chain):
    _, before, after = chain[4]
    assert {r["doc_id"] for r in after} == set(before)
    at = {}
    for r in sorted(after, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at.get(r["sequence_id"], 0)
        at[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(at.values()) <= 1024
