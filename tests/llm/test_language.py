import itertools
import random

import numpy as np
import pyarrow as pa

from peakflow.llm import language
from peakflow.llm.crf import posteriors
from peakflow.llm.language import accepted, fit, identify, train
from rows import empty_frame, odd_frame

WORDS = {"en": "the and thing of with that which", "de": "der und nicht schön für über das", "fr": "le et être où français que ça"}


def sample(lang, rng, count):
    return " ".join(rng.choice(WORDS[lang].split()) for _ in range(count))


def model():
    rng = random.Random(3)
    return fit([(lang, sample(lang, rng, 60)) for lang in WORDS for _ in range(12)])


def test_posteriors_equal_enumeration():
    rng = np.random.default_rng(2)
    lengths, k = [1, 4, 5], 3
    n = sum(lengths)
    scores, moves, opens = rng.normal(size=(n, k)), rng.normal(size=(k, k)), rng.normal(size=k)
    start = np.zeros(n, bool)
    start[np.cumsum([0] + lengths[:-1])] = True
    label, moved, first = posteriors(scores, start, moves, opens)
    at, all_moves, all_first = 0, np.zeros((k, k)), np.zeros(k)
    for length in lengths:
        total, want = 0.0, np.zeros((length, k))
        own_moves, own_first = np.zeros((k, k)), np.zeros(k)
        for path in itertools.product(range(k), repeat=length):
            log = opens[path[0]] + sum(scores[at + i, y] for i, y in enumerate(path))
            weight = np.exp(log + sum(moves[a, b] for a, b in zip(path, path[1:])))
            total += weight
            own_first[path[0]] += weight
            for i, y in enumerate(path):
                want[i, y] += weight
            for a, b in zip(path, path[1:]):
                own_moves[a, b] += weight
        assert np.allclose(label[at : at + length], want / total)
        all_moves, all_first, at = all_moves + own_moves / total, all_first + own_first / total, at + length
    assert np.allclose(moved, all_moves) and np.allclose(first, all_first)


def test_long_sequences_cross_chunks():
    rng = np.random.default_rng(4)
    scores, start = rng.normal(size=(700, 2)), np.zeros(700, bool)
    start[0] = start[333] = True
    label, _, _ = posteriors(scores, start, np.eye(2), np.zeros(2))
    alone, _, _ = posteriors(scores[333:], start[333:], np.eye(2), np.zeros(2))
    assert np.allclose(label[333:], alone)


def test_code_switched_words_are_told_apart():
    rng = random.Random(8)
    names, scores = model().label(pa.array([sample("de", rng, 30), sample("en", rng, 25) + " " + sample("fr", rng, 5)]))
    assert names == ["de", "en"] and scores[0] > 0.9 and 0.6 < scores[1] < 0.97


def test_held_out_accuracy(spark, sf_dir):
    from peakflow.llm.queries import op5_language_id

    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = [r for r in op5_language_id(spark, sf_dir).collect() if r.held_out]
    assert len(rows) > 30 and sum(r.lang_pred == lang[r.doc_id] for r in rows) >= 0.97 * len(rows)


def test_odd_rows(spark):
    df = odd_frame(spark, extra=True)
    learned = train(df)
    assert learned.languages == ["de", "en", "fr"]
    rows = identify(df, learned).collect()
    assert len(rows) == 32 and all(0 <= r.score <= 1 for r in rows)
    unknown = sorted((r.doc_id or 0, r.score) for r in rows if r.lang_pred == "und")
    assert unknown == [(0, 0.0), (4, 0.0), (5, 0.0), (6, 0.0), (9, 0.0)]
    assert accepted(df, learned, 0.0).count() == 27 and accepted(df, learned).columns == df.columns


def test_sample_is_bounded_by_rows_and_code_points(spark, monkeypatch):
    """Also where rows share one doc_id or have none, and where a text has no spaces."""
    taken = []
    monkeypatch.setattr(language, "fit", lambda rows, **options: taken.extend(rows))
    rows = [(None, f"text {i} " + "x" * 9000, "en") for i in range(400)] + [(1, "same", "de")] * 300
    train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_language=50, points_per_document=700)
    counts = {lang: sum(own == lang for own, _ in taken) for lang in ("en", "de")}
    assert 20 < counts["en"] <= 50 and counts["de"] <= 50 and max(len(t) for _, t in taken) == 700


def test_marks_alone_are_no_letters():
    names, scores = model().label(pa.array(["\u0301\u0308 \u0327", "e\u0301te\u0301 the and", "\u0301"]))
    assert names[0] == names[2] == "und" and scores[0] == 0 and names[1] != "und"


def test_nothing_to_learn_from(spark):
    assert identify(empty_frame(spark), train(empty_frame(spark))).collect() == []
    df = odd_frame(spark).drop("lang").selectExpr("*", "cast(null as string) as lang")
    assert {(r.lang_pred, r.score) for r in identify(df, train(df)).collect()} == {("und", 0.0)}
