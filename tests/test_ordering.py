"""Distributed ranks, running totals and percentiles against plain Python."""

import statistics

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cases import dicts
from peakflow.operators import ordering
from peakflow.operators.latency import PERCENTS, latency_stats

FEW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
ROWS = st.lists(st.tuples(st.sampled_from([None, "a", "b"]), st.integers(0, 5)), min_size=1, max_size=60)


@FEW
@given(ROWS)
def test_row_numbers(spark, rows):
    data = [(g, v, i) for i, (g, v) in enumerate(rows)]
    df = spark.createDataFrame(data, "g string, v int, i int").repartition(5)
    got = {r["i"]: r["row_no"] for r in dicts(ordering.with_row_number(df, ["g"], ["v", "i"]))}
    want = {}
    for group in {g for g, _, _ in data}:
        for n, (_, _, i) in enumerate(sorted((r for r in data if r[0] == group), key=lambda r: r[1:])):
            want[i] = n
    assert got == want


@FEW
@given(st.lists(st.integers(0, 9), min_size=1, max_size=50), st.integers(1, 7))
def test_running_sums_and_previous_values(spark, values, block):
    df = spark.createDataFrame([("r", i, v) for i, v in enumerate(values)], "run string, seq long, v long")
    both = ordering.with_previous(
        ordering.with_running_sums(df, "run", "seq", {"total": "v"}, block), "run", "seq", {"before": "total"}, 0, block
    )
    got = sorted((r["seq"], r["total"], r["before"]) for r in dicts(both))
    assert got == [(i, sum(values[: i + 1]), sum(values[:i])) for i in range(len(values))]


def _percentile(values, percent):
    values = sorted(values)
    at = (len(values) - 1) * percent / 100
    low, share = int(at), at - int(at)
    return values[low] + (values[min(low + 1, len(values) - 1)] - values[low]) * share


@FEW
@given(ROWS)
def test_percentiles(spark, rows):
    df = spark.createDataFrame([(g, float(v)) for g, v in rows], "g string, v double")
    counts = df.groupBy("g", "v").agg(F.count("*").alias("n"))
    placed = ordering.sorted_slices(counts, ["g", "v"], "test")
    got = {r["g"]: r for r in dicts(ordering.percentiles(placed, ["g"], "v", "n", PERCENTS))}
    for group in {g for g, _ in rows}:
        values = [float(v) for g, v in rows if g == group]
        for name, percent in PERCENTS.items():
            assert got[group][name] == pytest.approx(_percentile(values, percent))


def log_df(spark, rows):
    return spark.createDataFrame(
        rows, "event_hour string, publish_to_read_latency_ms double, arrival_latency_ms double"
    )


def test_latency_stats(spark):
    rows = [("12:00", 1.0, 1.0), ("13:00", 2.0, 1.0), ("18:00", 10.0, 4.0), ("11:00", 5.0, 2.0), ("", 7.0, 7.0)]
    rows += [("03:00", None, 1.0), ("03:00", 1.0, None)]  # unreadable rows are skipped
    stats = {r["segment"]: r for r in dicts(latency_stats(log_df(spark, rows)))}
    assert [stats[s]["records"] for s in ("all", "peak", "shoulder", "off-peak")] == [5, 3, 1, 0]
    assert stats["peak"]["p95"] == pytest.approx(9.2)
    assert stats["peak"]["std"] == pytest.approx(statistics.pstdev([1, 2, 10]))
    assert stats["shoulder"]["std"] == 0.0 and stats["shoulder"]["median"] == 5.0
    assert set(v for k, v in stats["off-peak"].items() if k != "segment") == {0}
    assert stats["all"]["arrival_mean"] == pytest.approx(3.0)


def test_percentiles_of_one_hot_value(spark):
    counts = spark.createDataFrame([("g", 1.0, 10**11), ("g", 2.0, 1)], "g string, v double, n long")
    placed = ordering.sorted_slices(counts, ["g", "v"], "test")
    got = ordering.percentiles(placed, ["g"], "v", "n", {"median": 50, "p100": 100}).first()
    assert (got["median"], got["p100"]) == (1.0, 2.0)


def test_copies_of_one_row_are_spread(spark):
    df = spark.range(50_000).select(F.lit("hot").alias("g"), F.lit(1).alias("k"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        numbered = ordering.with_row_number(df, ["g"], ["k"])
        assert numbered.select("row_no").distinct().count() == 50_000
        assert numbered.agg(F.max("row_no")).first()[0] == 49_999
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_one_group_is_cut_into_several_tasks(spark):
    """A group far larger than a block is numbered by several tasks."""
    df = spark.range(200_000).select(F.lit("hot").alias("g"), F.col("id").alias("k"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = ordering.sorted_slices(df, ["g", "k"], "test")
        assert placed.select("_slice").distinct().count() > 1
        numbered = ordering.with_row_number(df, ["g"], ["k"])
        assert numbered.where("row_no <> k").count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
