import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cases import dicts, event, events_df
from peakflow.operators import publishing
from peakflow.schemas import PUBLISH_PROGRESS
from peakflow.sinks.files import write_evidence
from peakflow.sources import payloads
from peakflow.sources.evidence import read_latency_csv, read_progress_csv


def feed(spark, per_hour):
    records = [
        event(f"{h:02d}-{i:05d}", f"o{h}-{i}", time=f"2024-01-01T{h:02d}:{i % 60:02d}:00Z")
        for h, n in per_hour.items()
        for i in range(n)
    ]
    return events_df(spark, records)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.dictionaries(st.integers(0, 23), st.integers(1, 12), min_size=1, max_size=4), st.integers(1, 5))
def test_plan_and_numbering_agree(spark, per_hour, size):
    events = feed(spark, per_hour)
    plan = sorted(dicts(publishing.replay_plan(events, size, 30.0)), key=lambda r: r["release_offset_seconds"])
    assert len(plan) == sum(math.ceil(n / size) for n in per_hour.values())
    assert sum(r["batch_records"] for r in plan) == sum(per_hour.values())
    for place, hour in enumerate(sorted(per_hour)):
        mine = [r for r in plan if r["event_hour"] == f"{hour:02d}:00"]
        assert mine[0]["release_offset_seconds"] == 30.0 * place
        assert sum(r["spacing_seconds"] for r in mine) == pytest.approx(30.0)
    numbered = publishing.with_batch_number(events, size).groupBy("event_hour", "batch_no").count()
    assert sorted((f"{r.event_hour:02d}:00", r.batch_no, r["count"]) for r in numbered.collect()) == sorted(
        (r["event_hour"], r["batch_no"], r["batch_records"]) for r in plan
    )


def test_long_hours_unfold_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(publishing, "BLOCK_ROWS", 3)
    plan = dicts(publishing.replay_plan(feed(spark, {5: 17}), 2))
    assert sorted(r["batch_no"] for r in plan) == list(range(9))
    assert sum(r["batch_records"] for r in plan) == 17


def test_progress_and_throughput(spark):
    numbered = publishing.with_batch_number(feed(spark, {1: 5, 2: 3}), 2)
    log = publishing.batch_log(numbered, F.col("event_id") == "01-00001", F.lit(500))
    progress = publishing.publish_progress(publishing.with_batch_sequence(log))
    rows = sorted(dicts(progress), key=lambda r: r["batch_seq"])
    assert [r["published_records"] for r in rows] == [2, 4, 5, 7, 8]
    assert [float(r["elapsed_seconds"]) for r in rows] == [0.5, 1.0, 1.5, 2.0, 2.5]
    assert rows[0]["records_per_second"] == 4.0
    hours = {r["event_hour"]: r for r in dicts(publishing.publish_by_hour(progress))}
    assert {h: (r["records"], float(r["seconds"])) for h, r in hours.items()} == {"01:00": (5, 1.5), "02:00": (3, 1.0)}
    assert hours["02:00"]["max_records_per_second"] == 4.0
    summary = publishing.publish_summary(progress).first()
    assert (summary.total_records, summary.transient_failed_records, summary.batches) == (8, 1, 5)


def test_progress_log_survives_csv(spark, tmp_path):
    numbered = publishing.with_batch_number(feed(spark, {1: 5}), 2)
    progress = publishing.publish_progress(
        publishing.with_batch_sequence(publishing.batch_log(numbered, F.lit(False), F.lit(500)))
    )
    columns = "run_id batch_seq timestamp_utc elapsed_seconds event_hour batch_records published_records".split()
    columns += ["records_per_second", "transient_failed_records"]
    write_evidence(progress.withColumn("timestamp_utc", F.lit("2024-01-01T00:00:00Z")).select(columns), str(tmp_path / "p"), layout=PUBLISH_PROGRESS)
    again = read_progress_csv(spark, str(tmp_path / "p"))
    assert publishing.publish_summary(again).first() == publishing.publish_summary(progress).first()


def test_latency_log_skips_rows_without_numbers(spark, tmp_path):
    (tmp_path / "log.csv").write_text(
        "read_timestamp_utc,event_hour,records_read,publish_to_read_latency_ms,arrival_latency_ms,partition_key,event_id\n"
        "2024-01-01T00:00:00Z,00:00,1,12.5,3.25,s1,e1\n"
        "2024-01-01T00:00:00Z,00:00,2,,3.25,s1,e2\n"
        "2024-01-01T00:00:00Z,,3,7.0,x,s1,e3\n"
    )
    rows = dicts(read_latency_csv(spark, str(tmp_path / "log.csv")))
    assert [(r["event_id"], r["publish_to_read_latency_ms"]) for r in rows] == [("e1", 12.5)]


def test_payload_survives_the_stream(spark):
    events = events_df(spark, [event(items=(("p1", 1, 2.5), ("p2", 2, 0.0))), event("e2", store=None)])
    records = payloads.encode(events, F.to_timestamp(F.lit("2024-01-01 10:00:01.123456")))
    for data in (records, records.withColumn("data", F.unbase64("data"))):
        back = {r["event_id"]: r for r in dicts(payloads.decode(data))}
        assert back["e1"]["partition_key"] == "s1" and back["e2"]["partition_key"] is None
        assert [tuple(i) for i in back["e1"]["items"]] == [("p1", 1, 2.5), ("p2", 2, 0.0)]
        assert back["e1"]["_published_at_utc"] == "2024-01-01T10:00:01.123456Z"


def test_failed_requests(spark):
    requests = spark.createDataFrame([(1, 0, "e1"), (1, 1, "e2"), (2, 0, "e3")], "batch_id int, seq int, event_id string")
    results = spark.createDataFrame(
        [(1, 0, None), (1, 1, "Throttled"), (2, 0, "Throttled")], "batch_id int, seq int, error_code string"
    )
    assert sorted(r["event_id"] for r in dicts(publishing.failed_requests(requests, results))) == ["e2", "e3"]
    assert dicts(publishing.error_counts(results)) == [{"error_code": "Throttled", "failed_records": 2}]


def test_old_records_and_large_totals_end_no_job(spark):
    """A record read 300 days after its publish; totals beyond eighteen digits."""
    from decimal import Decimal

    from peakflow.functions.money import grand_total, sales
    from peakflow.operators.latency import latency_stats

    log = spark.createDataFrame(
        [("12:00", 300 * 86_400_000.0, 1.0), ("12:00", 5.0, 1.0)],
        "event_hour string, publish_to_read_latency_ms double, arrival_latency_ms double",
    )
    row = next(r for r in latency_stats(log).collect() if r.segment == "all")
    assert (row.records, float(row.max)) == (2, 300 * 86_400_000.0)
    big = spark.createDataFrame([(Decimal("9999999999.99"),)], "x decimal(12,2)").selectExpr("x", "explode(sequence(1, 2000000)) AS n")
    got = big.agg(sales(F.col("x")).alias("s"), grand_total(F.col("x")).alias("g")).first()
    assert got.s is None and got.g == Decimal("9999999999.99") * 2_000_000
