import numpy as np
import pytest

import brute
from peakflow.llm import neighbours
from peakflow.llm.neighbours import hadamard, nearest

SCHEMA = "vec_id long, embedding array<float>"


def rows_of(df):
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in df.collect())


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(1).normal(size=(5, 16))
    assert np.allclose((hadamard(x) ** 2).sum(axis=1), (x**2).sum(axis=1))
    assert np.allclose(hadamard(hadamard(x)), x)


def test_recall_on_the_given_vectors(spark):
    from peakflow.llm.queries import op8_nearest_neighbours

    sf = "/root/testdata/sf0.1"
    vectors = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    want = {(q, v) for q, _, v, _ in brute.nearest(vectors, 20, 20)}
    got = rows_of(op8_nearest_neighbours(spark, sf))
    assert len({(q, v) for q, _, v, _ in got} & want) >= 0.95 * len(want)
    for q, _, v, score in got:
        assert abs(score - float(np.dot(vectors[q], vectors[v]))) < 1e-12


@pytest.mark.parametrize("lengths", ["1% ten times", "5% twice", "spread"])
def test_recall_on_vectors_of_unequal_length(spark, lengths):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(8000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    share, times = {"1% ten times": (0.01, 10), "5% twice": (0.05, 2), "spread": (0, 1)}[lengths]
    x *= np.where(rng.random(len(x)) < share, times, 1)[:, None]
    if lengths == "spread":
        x *= rng.uniform(0.2, 1, len(x))[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {(q, v) for q, _, v, _ in rows_of(nearest(df, every=40))}
    scores = x[::40] @ x.T
    scores[np.arange(len(scores)), np.arange(0, len(x), 40)] = -np.inf
    want = {(40 * q, v) for q, best in enumerate(np.argsort(-scores, axis=1)[:, :20].tolist()) for v in best}
    assert len(got & want) >= 0.97 * len(want)


def test_equal_vectors_go_by_id_in_small_cells(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL_ROWS", 16)
    monkeypatch.setattr(neighbours, "CELL_QUERIES", 2)
    rng = np.random.default_rng(3)
    data = {i: rng.normal(size=6).round(2) * (1 + i % 3) for i in range(60)}
    data |= {i: data[0] for i in range(100, 170)}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in data.items()], "vec_id long, embedding array<double>")
    got, want = rows_of(nearest(df, k=5)), brute.nearest(data, 5, 20)
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert np.allclose([r[3] for r in got], [r[3] for r in want])


def test_odd_rows(spark):
    rows = [
        (0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [None, 1.0]), (5, [float("nan"), 1.0]),
        (6, [float("inf"), 1.0]), (7, [2.0, 0.0]), (8, [1.0, 0.0, 0.0]), (9, []), (None, [1.0, 1.0]), (7, [2.0, 0.0]), (20, [0.0, -1.0]),
    ]
    df = spark.createDataFrame([(*r, "z") for r in rows], SCHEMA + ", rank string")
    assert rows_of(nearest(df)) == [
        (0, 1, 7, 2.0), (0, 2, 1, 0.5), (0, 3, 20, 0.0), (20, 1, 0, 0.0), (20, 2, 7, 0.0), (20, 3, 1, -0.5),
    ]
    empty = nearest(df.where("false"))
    assert empty.collect() == [] and empty.columns == ["query_id", "rank", "vec_id", "score"]
    assert nearest(df.where("vec_id = 1")).collect() == []
