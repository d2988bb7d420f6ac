import hashlib
import random

import numpy as np
import pytest

import brute
from peakflow.llm import repeats
from peakflow.llm.repeats import SuffixSort, remove_repeats
from rows import empty_frame, odd_documents, odd_frame


def found(df, length=200, gram=32):
    rows = remove_repeats(df, length, gram).collect()
    return sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in rows)


def wanted(docs, length=200):
    return sorted((d, *x) for d, x in brute.repeats(docs, length).items())


@pytest.mark.parametrize("letters", ["ab", "abcdefgh"])
def test_equals_brute_force(spark, letters):
    rng = random.Random(len(letters))
    shared = ["".join(rng.choice(letters) for _ in range(rng.randrange(10, 90))) for _ in range(6)]
    docs = {}
    for i in range(40):
        parts = ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 40))) for _ in range(4)]
        docs[i] = "".join(p + rng.choice(shared) for p in parts)
    docs |= {100: "a" * 90, 101: "ab" * 60, 102: None, 103: "", 104: docs[0], 105: "a" * 19, 106: "é" * 30}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert found(df, 20, 6) == wanted(docs, 20)


def test_grams_with_many_variants_are_spread(spark, monkeypatch):
    monkeypatch.setattr(repeats, "MOST_VARIANTS", 2)
    rng = random.Random(5)
    shared = "".join(rng.choice("abcd") for _ in range(60))
    docs = {i: "".join(rng.choice("abcd") for _ in range(30)) + shared + "".join(rng.choice("abcd") for _ in range(9)) for i in range(25)}
    docs |= {50: docs[3], 51: docs[4][10:], 52: shared * 2}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert found(df, 20, 6) == wanted(docs, 20)


def test_odd_rows(spark):
    rows = remove_repeats(odd_frame(spark, extra=True)).collect()
    assert len(rows) == 32
    by_id = {r.doc_id: r for r in rows}
    base = dict((d, t) for d, t, *_ in odd_documents())
    unique = {d: t for d, t in base.items() if d not in (None, 13)}
    for doc_id, *want in wanted(unique):
        r = by_id[doc_id]
        assert [r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()] == want
    assert [r.n_removed == r.n_bytes > 200 for r in rows if r.doc_id == 13] == [True, True]
    assert by_id[14].n_removed == 5000 and by_id[14].n_spans == 1  # repeats itself


def test_empty_table(spark):
    assert remove_repeats(empty_frame(spark)).collect() == []


def test_mergesort_orders_suffixes():
    data = np.frombuffer(b"banana bandana banana" + b"\0" * 8, np.uint8)
    place = np.arange(21)
    order = SuffixSort(data, 8).sorted(place, np.zeros(21, int))
    assert [data[p : p + 8].tobytes() for p in order] == sorted(data[p : p + 8].tobytes() for p in place)


def test_colliding_hashes_do_not_mislead(monkeypatch):
    sort = SuffixSort(np.frombuffer(b"abcdxxabceyyabcdzz", np.uint8), 4)
    sort.prefix = np.zeros_like(sort.prefix)  # every hash is equal
    place = np.array([0, 6, 12])
    assert sort.repeated(place, np.zeros(3, int)).tolist() == [0, 12]
