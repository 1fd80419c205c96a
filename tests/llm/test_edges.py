"""Rows without id, clashing columns, very long texts and repeated rows, for operators tested elsewhere without them."""

import pytest

import brute
from linkwright.llm import ann, decontaminate, neardup, packing, substrings, suffix_lm

LONG = "word " * 60_000 + "y" * 300_000


@pytest.fixture(scope="module")
def odd(spark):
    shared = " ".join(f"s{i}" for i in range(70))
    rows = [(None, shared, 1, 2, 3), (None, None, 1, 2, 3), (4, shared, 1, 2, 3), (4, shared, 1, 2, 3), (9, LONG, 1, 2, 3), (7, "", 1, 2, 3)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, length int, n_words int, score int")


def test_packing(odd):
    rows = packing.pack(odd).collect()
    assert {r.doc_id for r in rows} == {None, 4, 7, 9}
    whole = [r.doc_tokens for r in rows if r.doc_id == 9]
    assert whole and sum(r.length for r in rows if r.doc_id == 9) == whole[0] > 100_000
    assert sorted(r.length for r in rows if r.doc_id == 7) == [1]


def test_decontamination(spark, odd):
    items = spark.createDataFrame([("a", " ".join(f"s{i}" for i in range(20, 40)), 1)], "item_id string, text string, spans int")
    rows = decontaminate.report(odd, items).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_hit, r.contaminated) for r in rows) == [
        (0, 0, 0, False), (0, 70, 20, True), (4, 70, 20, True), (4, 70, 20, True), (7, 0, 0, False), (9, 60_001, 0, False)
    ]
    assert decontaminate.remove_contaminated(odd, items).columns == odd.columns


def test_substrings(odd):
    rows = substrings.report(odd).collect()
    # a row without id stands before no other; a row's own copies share its id
    found = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in rows)
    assert [x[:2] for x in found] == [(0, 0), (0, 70), (4, 70), (4, 70), (7, 0), (9, 60_001)]
    assert all(removed == 0 for doc, _, removed in found if doc in (4, 7, 9))


def test_language_model(odd):
    rows = suffix_lm.report(odd).collect()
    assert len(rows) == 6 and all(r.score <= 0 and r.base_score < 0 for r in rows)
    assert {r.held_out for r in rows if r.doc_id is None} == {False}
    assert [r.n_tokens for r in rows if r.doc_id == 9] == [60_002]


def test_near_duplicates(odd):
    rows = neardup.groups(odd).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in rows if r.doc_id) == [
        (4, 66, 4, True), (4, 66, 4, True), (7, 0, 7, True), (9, len(set(zip(*[brute.spaced(LONG)[i:] for i in range(5)]))), 9, True)
    ]
    assert neardup.one_of_each(odd).columns == odd.columns


def test_nearest_vectors(spark):
    rows = [(20, [1.0, 0.0], 1, 2), (20, [0.0, 5.0], 1, 2), (1, [3.0, 0.0], 1, 2), (None, [9.0, 9.0], 1, 2), (2, [0.0, 2.0], 1, 2), (3, [0.0, 2.0], 1, 2)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, score int, list int")
    # of rows that share an id the smallest vector counts; equal scores in the order of ids
    assert [tuple(r) for r in ann.report(frame).orderBy("rank").collect()] == [(20, 1, 2, 10.0), (20, 2, 3, 10.0), (20, 3, 1, 0.0)]
