"""Lags over gaps, drift of a mix, heavy keys."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from peakflow.operators import audit
from peakflow.operators.comparison import mix_drift, with_lags


def test_lags_are_aligned_by_the_hour_not_by_the_row(spark):
    orders = {("s", 0): 5, ("s", 1): 7, ("s", 24): 10, ("s", 27): 4, ("s", 168): 8, ("s", 169): 14, ("t", 24): 3, (None, 24): 2, (None, 0): 4}
    rows = [(s, h, n) for (s, h), n in orders.items()]
    hourly = spark.createDataFrame(rows, "store_id string, h int, order_count long").withColumn(
        "hour_start", F.timestamp_seconds(F.lit(1_704_067_200) + F.col("h") * 3600)
    )
    got = {(r.store_id, r.h): r for r in with_lags(hourly).collect()}
    assert len(got) == len(rows)

    def of(store, hour):
        return got[store, hour].prior_day, got[store, hour].change_day, got[store, hour].prior_week

    assert of("s", 0) == of("s", 1) == of("t", 24) == (None, None, None)  # not open so long ago
    assert of("s", 24) == (5, 1.0, None)
    assert of("s", 27) == (0, None, None)  # open, but without orders then
    assert of("s", 168) == (0, None, 5) and of("s", 169) == (0, None, 7)
    assert of(None, 24) == (4, -0.5, None)
    assert got["s", 24].trailing_day == 12 / 24 and got["s", 27].trailing_day == 10 / 24
    assert got["s", 169].trailing_week == (7 + 10 + 4 + 8) / 168 and got["s", 169].change_week == 1.0


def test_drift_of_sparse_mixes(spark):
    lunch, dinner = 12, 19
    rows = [
        *[("same", "a", lunch, 1), ("same", "b", lunch, 3), ("same", "a", dinner, 2), ("same", "b", dinner, 6)],
        *[("apart", "a", lunch, 5), ("apart", "b", dinner, 5), ("apart", "c", 3, 9)],
        *[("half", "a", lunch, 2), ("half", "a", dinner, 1), ("half", "b", dinner, 1)],
        *[("lunch only", "a", lunch, 2), (None, "x", lunch, 1), (None, "x", dinner, 1)],
    ]
    lines = spark.createDataFrame(rows, "store_id string, product_id string, h int, quantity int")
    got = {r.store_id: r for r in mix_drift(lines, F.col("h")).collect()}
    assert got["same"].divergence == pytest.approx(0) and got["apart"].divergence == pytest.approx(1)
    p, q = (1, 0), (0.5, 0.5)
    want = sum(x / 2 * math.log2(2 * x / (a + b)) for a, b in zip(p, q, strict=True) for x in (a, b) if x)
    assert got["half"].divergence == pytest.approx(want)
    assert (got["apart"].products, got["apart"].drifting_product, got["half"].drifting_product) == (2, "a", "b")
    assert got["lunch only"].divergence is None and got["lunch only"].second_units == 0
    assert got[None].divergence == pytest.approx(0)


def test_heavy_keys_are_found_within_the_stated_error(spark):
    """Two heavy keys among thousands of light ones, in sketches of ten groups with few counters."""
    keys = ["hot"] * 3_000 + ["warm"] * 1_500 + [f"k{i % 4_000}" for i in range(10_000)] + [None] * 500
    records = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "store_id string, id long").repartition(7)
    sketches = audit.key_sketches(records.withColumn("part", F.col("id") % 10), ["part"], counters=40)
    heavy = audit.heavy_keys(sketches, 0.1, counters=40)
    plan = audit.hot_key_plan(records, heavy, 8)
    found, exact = {r.partition_key: r for r in plan.collect()}, Counter(keys)
    assert {"hot", "warm"} <= set(found) and len(found) <= 40
    for key, r in found.items():
        assert r.records == exact[key] and abs(r.estimate - r.records) <= r.error < 14_500 * 0.1
        assert r.all_records == 14_500 and r.salts == math.ceil(exact[key] * 8 / 14_500)
    loads = audit.salted(records, plan, F.col("id")).groupBy("shard_key").count().collect()
    assert sum(r["count"] for r in loads) == len(keys)
    assert max(r["count"] for r in loads if r.shard_key) <= 14_500 / 8 + 1


def test_no_records(spark):
    none = spark.createDataFrame([], "store_id string, id long")
    heavy = audit.heavy_keys(audit.key_sketches(none, ["id"]), 0.1)
    assert heavy.collect() == [] and audit.hot_key_plan(none, heavy, 4).collect() == []
