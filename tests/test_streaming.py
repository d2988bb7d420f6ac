"""Streams give what the batch operators give, however the input is cut and interrupted."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from cases import dicts, event, write_jsonl
from peakflow.operators import dashboard, latency
from peakflow.operators.items import order_items
from peakflow.operators.latest import latest_per_key
from peakflow.plans import stream_queries
from peakflow.sources import payloads, streams, tables
from peakflow.sources.evidence import read_latency_csv
from peakflow.streaming import pipelines, windows
from peakflow.streaming.live import LiveCounters, RunningCounts, run_live
from peakflow.streaming.progress import ProgressLog


def split_into(spark, sf_dir, folder, parts, suffix=""):
    """The event table cut into files in time order."""
    rows = tables.table(spark, sf_dir, "events").orderBy("ts").toPandas()
    size = -(-len(rows) // parts)
    schema = tables.table(spark, sf_dir, "events").schema
    for i in range(parts):
        piece = spark.createDataFrame(rows.iloc[i * size : (i + 1) * size], schema).coalesce(1)
        piece.write.mode("append").parquet(f"{folder}/part{suffix}={i}")
    return schema


def file_stream(spark, folder, schema, per_batch=1):
    return streams.parquet_stream(spark, f"{folder}/*", schema, per_batch)


def sections(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_live_snapshot_equals_batch(spark, sf_dir, tmp_path, parts):
    schema = split_into(spark, sf_dir, tmp_path / "in", parts)
    counters = LiveCounters(spark, str(tmp_path / "state"))
    counters.store_hours.fold_every = counters.products.fold_every = 2
    batches = []
    stream = tables.from_event_table(file_stream(spark, tmp_path / "in", schema))
    run_live(stream, counters, str(tmp_path / "cp"), batches.append).awaitTermination()
    assert len(batches) == parts
    events = tables.replay_events(spark, sf_dir)
    want = dashboard.dashboard_sections(
        dashboard.event_counts(events), dashboard.product_totals(order_items(events)), kind="fixed_24_floor1"
    )
    assert sections(counters.snapshot()) == sections(want)
    progress = counters.progress(events.agg(F.count("*").alias("n"))).first()
    assert (progress.processed_events, progress.total_source_events, progress.progress) == (1000, 1000, 1.0)


def test_live_goes_on_after_a_crash(spark, sf_dir, tmp_path):
    """The third batch fails after its counters are written; the rerun must not count it twice."""
    schema = split_into(spark, sf_dir, tmp_path / "in", 5)
    counters = LiveCounters(spark, str(tmp_path / "state"))
    counters.store_hours.fold_every = counters.products.fold_every = 2

    def stream():
        return tables.from_event_table(file_stream(spark, tmp_path / "in", schema))

    def crash(batch_id):
        if batch_id == 2:
            raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        run_live(stream(), counters, str(tmp_path / "cp"), crash).awaitTermination()
    assert counters.counts().agg(F.sum("events")).first()[0] == 600
    run_live(stream(), counters, str(tmp_path / "cp")).awaitTermination()
    want = dashboard.event_counts(tables.replay_events(spark, sf_dir))
    assert sections(counters.counts().select("store_id", "hour", "events")) == sections(want)


def test_same_batch_twice_counts_once(spark, sf_dir, tmp_path):
    counters = LiveCounters(spark, str(tmp_path / "state"))
    events = tables.replay_events(spark, sf_dir)
    for batch_id in (0, 0, 1, 1):
        counters.apply(events, batch_id)
    counters.store_hours.compact(1)
    counters.apply(events, 1)
    assert counters.counts().agg(F.sum("events")).first()[0] == 2000
    counters.store_hours.remove_folded()
    assert [p.name for p in (tmp_path / "state" / "store_hours" / "batch").iterdir()] == ["id=000000000001"]
    assert counters.counts().agg(F.sum("events")).first()[0] == 2000


def test_stored_copies_can_be_removed(spark):
    from pathlib import Path

    from peakflow import session

    session.clear_scratch()
    with pytest.raises(ValueError), session.scratch():
        session.materialise(spark.range(3), "copy")
        path = Path(session._stored[-1][1])
        assert path.exists()
        raise ValueError("the query fails")
    assert not path.exists() and not session._stored


def test_empty_counters(spark, tmp_path):
    counters = LiveCounters(spark, str(tmp_path / "state"))
    progress = counters.progress(spark.range(0).agg(F.count("*").alias("n"))).first()
    assert (progress.processed_events, progress.progress) == (0, 0.0)


@pytest.mark.parametrize("order", ["as is", "reversed"])
def test_upserts_do_not_depend_on_the_order_of_batches(spark, sf_dir, tmp_path, order):
    events = tables.replay_events(spark, sf_dir).select("customer_id", "event_id", "event_ts")
    cuts = [events.where("event_ts < '2024-01-11'"), events.where("event_ts >= '2024-01-09'")]
    state = pipelines.latest_state(spark, str(tmp_path / "s"), events, ["customer_id"], ["event_ts", "event_id"], 1)
    for i, batch in enumerate(cuts if order == "as is" else cuts[::-1]):
        state.apply(i, batch)
    state.apply(1, (cuts if order == "as is" else cuts[::-1])[1])
    state.apply(2, events.limit(0))
    want = latest_per_key(events, ["customer_id"], ["event_ts", "event_id"])
    assert sections(state.read()) == sections(want)


def test_upsert_stream(spark, sf_dir, tmp_path):
    schema = split_into(spark, sf_dir, tmp_path / "in", 4)
    rows = tables.from_event_table(file_stream(spark, tmp_path / "in", schema)).select(
        "customer_id", "event_id", "event_ts"
    )
    state = pipelines.latest_state(spark, str(tmp_path / "s"), rows, ["customer_id"], ["event_ts", "event_id"], 2)
    pipelines.run_upserts(rows, state, str(tmp_path / "cp")).awaitTermination()
    events = tables.replay_events(spark, sf_dir).select("customer_id", "event_id", "event_ts")
    assert sections(state.read()) == sections(latest_per_key(events, ["customer_id"], ["event_ts", "event_id"]))


def lines(folder, name, times, ids=None, orders=None):
    folder.mkdir(exist_ok=True)
    records = [
        event(ids[i] if ids else f"{name}-{i}", orders[i] if orders else f"o-{name}-{i}", time=t)
        for i, t in enumerate(times)
    ]
    write_jsonl(folder / f"{name}.json", records)


def run_parquet(rows, tmp_path):
    pipelines.run_to_parquet(rows, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()


def test_duplicates_within_the_watermark(spark, tmp_path):
    lines(tmp_path / "in", "a", ["2024-01-01T10:00:00Z"] * 3, ids=["x", "x", "y"])
    lines(tmp_path / "in", "b", ["2024-01-01T10:05:00Z"] * 2, ids=["x", "z"])
    stream = streams.json_event_stream(spark, str(tmp_path / "in"), 1)
    run_parquet(pipelines.without_duplicates(stream, "1 hour").select("event_id"), tmp_path)
    assert sorted(r[0] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["x", "y", "z"]


def test_dedup_does_not_depend_on_the_span_of_the_table(spark, sf_dir, tmp_path):
    """Events over a year: landings go back in time by far more than any fixed watermark."""
    from peakflow.plans.stream_queries import stream_dedup

    source = tables.table(spark, sf_dir, "events")
    days = F.make_dt_interval(F.col("event_id") % 365)
    source.withColumn("ts", F.col("ts") + days).write.parquet(str(tmp_path / "sf" / "events.parquet"))
    got = [r.event_id for r in stream_dedup(spark, str(tmp_path / "sf")).collect()]
    want = {str(r.event_id) for r in source.select("event_id").collect()}
    assert len(got) == len(want) and set(got) == want


def test_hourly_counts_on_a_stream(spark, tmp_path):
    """Two events of one order in one hour count once; an event behind the watermark is left out."""
    folder = tmp_path / "in"
    lines(folder, "1", ["2024-01-01T10:00:00Z", "2024-01-01T10:50:00Z", "2024-01-01T10:20:00Z"], orders=["o1", "o1", "o2"])
    lines(folder, "2", ["2024-01-01T14:00:00Z"])
    # Late rows are judged by the watermark of the batch before, so one more batch comes first.
    lines(folder, "3", ["2024-01-01T14:10:00Z"])
    lines(folder, "4", ["2024-01-01T10:30:00Z"])
    lines(folder, "5", ["2024-01-03T00:00:00Z"])  # closes the open windows
    for i in range(1, 6):
        os.utime(folder / f"{i}.json", (1_700_000_000 + i * 10, 1_700_000_000 + i * 10))
    stream = streams.json_event_stream(spark, str(folder), 1)
    query = pipelines.run_to_parquet(
        pipelines.hourly_order_counts(stream, "1 hour"), str(tmp_path / "out"), str(tmp_path / "cp")
    )
    query.awaitTermination()
    rows = {str(r.hour_start): r.order_count for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert rows["2024-01-01 10:00:00"] == 2 and rows["2024-01-01 14:00:00"] == 2
    dropped = [s.numRowsDroppedByWatermark for p in query.recentProgress for s in p.stateOperators]
    assert sum(dropped) > 0


def test_alarms_on_a_stream(spark, tmp_path):
    folder, seen = tmp_path / "in", []
    lines(folder, "1", ["2024-01-01T10:00:01Z", "2024-01-01T10:00:59Z", "2024-01-01T10:02:30Z"])
    lines(folder, "2", ["2024-01-01T12:00:00Z"])
    stream = streams.json_event_stream(spark, str(folder), 1)
    alarms = latency.ingestion_alarms(stream, "event_ts", threshold=2, late="10 seconds")
    pipelines.run_alarms(alarms, lambda rows, _: seen.extend(rows.collect()), str(tmp_path / "cp")).awaitTermination()
    assert [(str(r.period_start), r.records) for r in seen] == [("2024-01-01 10:00:00", 2)]


def test_latency_evidence_from_a_stream(spark, sf_dir, tmp_path):
    from peakflow.plans.stream_queries import _records

    records = _records(spark, sf_dir)
    records.write.parquet(str(tmp_path / "in"))
    stream = payloads.decode(streams.parquet_stream(spark, str(tmp_path / "in"), records.schema))
    rows = latency.read_latencies(stream, F.col("read_at"), F.col("arrived_at"))
    assert pipelines.run_to_evidence(rows, str(tmp_path / "out"), str(tmp_path / "cp")) == 1000
    back = read_latency_csv(spark, str(tmp_path / "out" / "*"))
    want = tables.read_log(spark, sf_dir)
    assert sorted(r.records_read for r in back.collect()) == list(range(1, 1001))
    total = "sum(round(publish_to_read_latency_ms * 100))"
    assert back.selectExpr(total).first() == want.selectExpr(total).first()


def test_bounded_observation(spark, sf_dir, tmp_path):
    from peakflow.plans.stream_queries import _records

    records = _records(spark, sf_dir)
    for i in range(3):
        records.limit(40).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = payloads.decode(streams.parquet_stream(spark, str(tmp_path / "in"), records.schema, 1))
    rows = latency.read_latencies(stream, F.col("read_at"), F.col("arrived_at"))
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    for bound, written in ((10, 10), (10, 10), (50, 50), (80, 80), (81, 81), (500, 120)):
        assert pipelines.run_to_evidence(rows, out, checkpoint, max_records=bound) == written
        back = read_latency_csv(spark, f"{out}/*")
        assert sorted(r.records_read for r in back.collect()) == list(range(1, written + 1))
    assert sorted(r.records_read for r in read_latency_csv(spark, f"{out}/*").collect()) == list(range(1, 121))


def test_another_header_is_refused(spark, tmp_path):
    (tmp_path / "log.csv").write_text("event_hour,records_read\n10:00,1\n")
    with pytest.raises(Exception):
        read_latency_csv(spark, str(tmp_path / "log.csv")).collect()


def test_stream_from_the_latest_file_on(spark, tmp_path):
    spark.range(3).coalesce(1).write.parquet(str(tmp_path / "in" / "old"))
    for file in (tmp_path / "in" / "old").glob("part-*"):
        os.utime(file, (1_700_000_000, 1_700_000_000))
    since = datetime.datetime(2024, 1, 1)
    spark.range(10, 12).coalesce(1).write.parquet(str(tmp_path / "in" / "new"))
    rows = streams.parquet_stream(spark, str(tmp_path / "in" / "*"), spark.range(0).schema, since=since)
    pipelines.run_to_parquet(rows, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [10, 11]


def test_stream_from_the_position_at_its_first_start(spark, tmp_path):
    """Clocks play no part: a file that is dated back but lands after the start is read."""
    home, schema = str(tmp_path / "in"), spark.range(0).schema

    def land(first, last):
        before = set((tmp_path / "in").glob("part-*")) if (tmp_path / "in").exists() else set()
        spark.range(first, last).coalesce(1).write.mode("append").parquet(home)
        for file in set((tmp_path / "in").glob("part-*")) - before:
            os.utime(file, (1_700_000_000 - first, 1_700_000_000 - first))

    def run():
        rows = streams.latest_stream(spark, home, schema, str(tmp_path / "position"))
        pipelines.run_to_parquet(rows, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        return sorted(r.id for r in spark.read.schema(schema).parquet(str(tmp_path / "out")).collect())

    land(0, 3)
    assert run() == []
    land(10, 12)
    assert run() == [10, 11]
    land(20, 22)
    assert run() == run() == [10, 11, 20, 21]


def test_running_counts_take_a_repeated_batch_once(spark, tmp_path):
    counts = RunningCounts(spark, str(tmp_path / "totals"), fold_every=1)
    rows = lambda *n: spark.createDataFrame([("s", 9, i) for i in n], "store_id string, hour int, events long")
    for batch, total in ((0, 3), (0, 3), (1, 5), (1, 5), (2, 4)):  # the newest batch wins, not the largest total
        counts.totals.apply(batch, rows(total).withColumn("batch", F.lit(batch).cast("long")))
        assert [r.events for r in counts.read().collect()] == [total]


def test_progress_of_a_stream(spark, tmp_path):
    """Rows read over several starts, rows too late, and what is held in the end."""
    home = str(tmp_path / "in")
    with ProgressLog(spark) as log:
        for times in (["10:00", "10:10"], ["14:00"], ["18:00"], ["10:20", "18:10"], ["23:00"]):
            rows = [(f"e{t}", "s", f"2024-01-01 {t}:00") for t in times]
            events = spark.createDataFrame(rows, "event_id string, store_id string, t string")
            events = events.withColumn("event_ts", F.col("t").cast("timestamp"))
            events.coalesce(1).write.mode("append").parquet(home)
            hours = pipelines.closed_hours(streams.parquet_stream(spark, home, events.schema), "1 hour")
            log.wait(pipelines.run_to_parquet(hours, str(tmp_path / "out"), str(tmp_path / "cp")))
    assert (log.rows_read(), log.rows_dropped()) == (7, 1)
    assert log.rows_held() <= 2  # the id and the hour of the last event
    got = spark.read.schema("hour_start timestamp, store_id string, events long").parquet(str(tmp_path / "out"))
    assert sorted((r.hour_start.hour, r.events) for r in got.collect()) == [(10, 2), (14, 1), (18, 2)]


def test_broken_payloads_stay(spark):
    rows = spark.createDataFrame([("s", "!!"), ("s", "bm90IGpzb24="), ("s", None)], "partition_key string, data string")
    assert [r.event_id for r in payloads.decode(rows).collect()] == [None] * 3


def test_late_rows_correct_closed_hours(spark, tmp_path):
    counts = windows.hourly_orders(spark, str(tmp_path / "state"), "1 hour", fold_every=1)
    batches = [["10:00", "10:50"], ["14:00"], ["10:30", "10:40"], ["14:10"]]
    for i, times in enumerate(batches):
        rows = [(f"o{i}-{t}", "s", f"2024-01-01 {t}:00") for t in times]
        df = spark.createDataFrame(rows, "order_id string, store_id string, event_ts string")
        df = df.withColumn("event_ts", F.to_timestamp("event_ts"))
        for _ in range(2):
            counts.apply(df, i)
    got = {str(r.hour_start)[11:16]: r.order_count for r in windows.order_counts(counts.read()).collect()}
    assert got == {"10:00": 4, "14:00": 2}
    log = counts.log.read().first()
    assert (log.rows, log.late_rows) == (6, 2)


def test_latency_needs_a_publish_time(spark):
    records = spark.createDataFrame(
        [("e1", "2024-01-01T10:00:00Z", None, "s"), ("e2", "bad", "2024-01-01T10:00:00Z", "s")],
        "event_id string, event_time string, _published_at_utc string, partition_key string",
    )
    at = F.to_timestamp(F.lit("2024-01-01 10:00:01.5"))
    rows = {r["event_id"]: r for r in dicts(latency.read_latencies(records, at, at))}
    assert rows["e1"]["publish_to_read_latency_ms"] is None and rows["e1"]["event_hour"] == "10:00"
    assert rows["e2"]["publish_to_read_latency_ms"] == 1500.0 and rows["e2"]["event_hour"] == ""


def test_batches_do_not_grow_with_the_files_of_a_landing(spark, sf_dir, tmp_path):
    """A table of more files lands in more files, and still a landing is a batch; rows without a time land too."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    timeless = events.limit(3).withColumn("ts", F.lit(None).cast(events.schema["ts"].dataType))
    events.unionAll(timeless).repartition(5).write.parquet(str(tmp_path / "events.parquet"))
    batches = []

    def on_batch(batch, batch_id):
        batches.append((batch.count(), {r.d for r in batch.select((F.dayofmonth("event_ts") % 4).alias("d")).distinct().collect()}))

    stream = stream_queries._event_stream(spark, str(tmp_path), str(tmp_path / "home"))
    query = stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True)
    query.start().awaitTermination()
    assert len(list((tmp_path / "home" / "landed").glob("*/part-*"))) > 4
    assert [days - {None} for _, days in batches] == [{0}, {1}, {2}, {3}]
    assert sum(n for n, _ in batches) == events.count() + 3
