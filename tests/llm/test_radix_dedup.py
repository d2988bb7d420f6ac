import hashlib

import pytest

import brute
from peakflow.llm import radix_dedup
from peakflow.llm.radix_dedup import exact_duplicates
from rows import empty_frame, odd_frame


def test_groups_equal_texts(spark):
    long = "k" * 3000
    docs = {
        1: long + "a", 2: long + "b", 3: long + "A", 4: long, 5: long[:64], 6: long[:65], 7: "", 8: None,
        9: "É", 10: "é", 11: long[:512], 12: long[:512], 13: "x\n", 14: "x",
    }
    rows = exact_duplicates(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()
    groups = {}
    for d, t in docs.items():
        groups.setdefault(brute.lower(t), []).append(d)
    assert len(rows) == len(docs)
    for r in rows:
        text = brute.lower(docs[r.doc_id])
        assert (r.keep_id, r.group_size) == (max(groups[text]), len(groups[text]))
        assert r.kept == (r.doc_id == r.keep_id)
        assert r.text_sha256 == hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("run", [1, 3])
def test_short_runs_take_many_rounds(spark, monkeypatch, run):
    monkeypatch.setattr(radix_dedup, "FIRST_RUN", run)
    monkeypatch.setattr(radix_dedup, "GROWTH", 2)
    rows = exact_duplicates(spark.createDataFrame([(1, "abcabc"), (2, "abcabd"), (3, "ABCabd"), (4, "ab")], "doc_id long, text string"))
    assert {r.doc_id: (r.keep_id, r.group_size) for r in rows.collect()} == {1: (1, 1), 2: (3, 2), 3: (3, 2), 4: (4, 1)}


def test_rounds_of_long_texts_are_few(spark, monkeypatch):
    """Runs grow without end, so texts of 9 MB that differ at the end take seven rounds."""
    rounds, store = [], radix_dedup.materialise
    monkeypatch.setattr(radix_dedup, "materialise", lambda df, name: rounds.append(name) or store(df, name))
    long = "k" * 9_000_000
    rows = exact_duplicates(spark.createDataFrame([(1, long + "a"), (2, long + "b"), (3, long + "A")], "doc_id long, text string"))
    assert {r.doc_id: r.keep_id for r in rows.collect()} == {1: 3, 2: 2, 3: 3}
    assert rounds.count("radix-groups") == 7


def test_odd_rows(spark):
    rows = exact_duplicates(odd_frame(spark, extra=True)).collect()
    assert len(rows) == 32
    by_id = {r.doc_id: r for r in rows}
    assert (by_id[1].keep_id, by_id[1].group_size, by_id[1].kept) == (3, 2, False)
    assert by_id[4].keep_id == 5 and by_id[4].group_size == 3  # with the empty text and the null row
    assert [(r.group_size, r.kept) for r in rows if r.doc_id == 13] == [(2, True), (2, True)]
    assert sorted((r.group_size, r.kept) for r in rows if r.doc_id is None) == [(1, True), (3, False)]


def test_empty_table(spark):
    assert exact_duplicates(empty_frame(spark)).collect() == []
