import random
from fractions import Fraction

import numpy as np
import pytest

import brute
from peakflow.llm import ngram_join
from peakflow.llm.ngram_join import PartEnum, jaccard_components, sketch_difference, sketches
from rows import empty_frame, odd_frame, words_at


def found(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def random_family(seed, count=60):
    """Copies of a few texts with ever more words changed, so that many pairs lie near the threshold."""
    rng = random.Random(seed)
    out = {}
    for i in range(count):
        words = words_at(1000 * (i % 4), rng.choice([6, 12, 40, 150])).split()
        for _ in range(rng.randrange(0, 1 + len(words) // 12)):
            words[rng.randrange(len(words))] = f"n{rng.randrange(50)}"
        out[i] = " ".join(words)
    return out


@pytest.mark.parametrize("seed", [1])
def test_components_equal_all_pairs(spark, seed):
    docs = random_family(seed)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert found(jaccard_components(df)) == brute.jaccard_components(docs)


def test_small_cells_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "CELL_ROWS", 3)
    docs = random_family(9, 80)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert found(jaccard_components(df)) == brute.jaccard_components(docs)


def test_odd_rows(spark):
    rows = jaccard_components(odd_frame(spark, extra=True)).collect()
    assert len(rows) == 32
    by_id = {r.doc_id: r for r in rows}
    assert {by_id[d].component_id for d in (1, 2, 3)} == {1}
    assert by_id[12].component_id == 12
    assert [by_id[d].n_shingles for d in (4, 5, 6)] == [0, 0, 0]
    assert [by_id[d].component_id for d in (4, 5, 6)] == [4, 5, 6]
    assert by_id[7].component_id == by_id[8].component_id == 7
    assert by_id[10].component_id == by_id[11].component_id == 10
    assert [r.component_id for r in rows if r.doc_id == 13] == [13, 13]
    assert [r.component_id for r in rows if r.doc_id is None] == [None, None]


def test_empty_table(spark):
    assert jaccard_components(empty_frame(spark)).collect() == []


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(5)
    rule = PartEnum(Fraction(80, 100))
    for size in [1, 2, 3, 4, 5, 7, 9, 16, 25, 26, 41, 64, 100, 164, 400, 1000]:
        for _ in range(20):
            a = rng.integers(0, 1 << 63, size).astype(np.uint64)
            gone = int(rng.integers(0, size // 5 + 1))
            added = int((size - gone - 0.8 * size) / 0.8) if size - gone >= 0.8 * size else 0
            b = np.concatenate([a[gone:], rng.integers(0, 1 << 63, added).astype(np.uint64)])
            common = size - gone
            if 100 * common < 80 * (size + added) or not len(b):
                continue
            both = np.concatenate([np.sort(a), np.sort(b)])
            s, owner = rule.signatures(both, np.array([0, size, size + len(b)]))
            assert set(s[owner == 0].tolist()) & set(s[owner == 1].tolist()), (size, gone, added)


def test_sketches_never_differ_more_than_sets():
    rng = np.random.default_rng(6)
    for sizes in ((150, 150), (600, 700), (500, 520), (3, 900)):
        a, b = (np.unique(rng.integers(0, 5000, n).astype(np.uint64)) for n in sizes)
        data, starts = sketches(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        differ = sketch_difference(data, starts, np.array([0, 0]), np.array([1, 0]))
        assert 0 < differ[0] <= len(np.setxor1d(a, b)) and differ[1] == 0
