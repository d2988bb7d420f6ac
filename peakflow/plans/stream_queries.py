"""Queries on stream records: payloads, latency, replay and publish logs, live state."""

from pyspark.sql import functions as F

from peakflow.operators import latency, latest, publishing
from peakflow.operators.dashboard import MATRIX as MATRIX_COLUMNS
from peakflow.operators.pressure import is_alert, severity
from peakflow.plans.registry import query, two_digits
from peakflow.plans.traffic_queries import DAY_THRESHOLD, EVENTS, MIN_ORDERS, SECTIONS
from peakflow.session import materialise, scratch_path
from peakflow.sinks.files import write_dated, write_evidence
from peakflow.sources import payloads, streams, tables
from peakflow.sources.evidence import read_latency_csv
from peakflow.streaming import windows
from peakflow.streaming.live import LiveCounters, RunningCounts, run_live
from peakflow.streaming.pipelines import (
    closed_hours,
    distinct_state,
    latest_state,
    run_alarms,
    run_to_evidence,
    run_to_parquet,
    run_upserts,
    without_duplicates,
)
from peakflow.streaming.progress import ProgressLog

ALARM_RECORDS = 2
LIVE_SECTIONS = SECTIONS.replace(
    "sum(orders) OVER (PARTITION BY store_id) / 24 AS baseline",
    "greatest(1.0, sum(orders) OVER (PARTITION BY store_id) / 24) AS baseline",
)

LATENCY = """
WITH travel AS (SELECT *, CAST(round(value * 10000) AS BIGINT) AS micros FROM events),
log AS (
  SELECT CAST(event_id AS VARCHAR) AS event_id, event_type AS partition_key, ts AS published_at,
    ts + to_microseconds(micros) AS read_at, strftime(ts, '%H') || ':00' AS event_hour,
    round(micros / 1000.0, 2) AS publish_to_read_latency_ms,
    round((micros - micros // 2) / 1000.0, 2) AS arrival_latency_ms, hour(ts) AS hour_no
  FROM travel
)"""


def _records(spark, sf_dir):
    """Events as they travel: key, encoded payload, and the times known to broker and reader."""
    micros = F.unix_micros("event_ts")
    travel = F.round(F.col("items")[0]["unit_price"] * 10000).cast("bigint")
    times = {
        "arrived_at": F.timestamp_micros(micros + F.floor(travel / 2)),
        "read_at": F.timestamp_micros(micros + travel),
    }
    timed = tables.replay_events(spark, sf_dir).withColumns(times)
    return payloads.encode(timed, F.col("event_ts"))


@query(
    EVENTS
    + """ SELECT store_id AS partition_key, event_id, order_id, customer_id, product_id, quantity, unit_price,
  strftime(event_ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS _published_at_utc FROM ev"""
)
def stream_payloads(spark, sf_dir):
    """Encode every event, decode it again and look inside."""
    decoded = payloads.decode(_records(spark, sf_dir))
    return decoded.select(
        "partition_key", "event_id", "order_id", "customer_id", F.col("items")[0].alias("item"), "_published_at_utc"
    ).select("partition_key", "event_id", "order_id", "customer_id", "item.*", "_published_at_utc")


@query(
    LATENCY
    + """ SELECT read_at, event_hour, publish_to_read_latency_ms, arrival_latency_ms, partition_key, event_id
  FROM log"""
)
def latency_rows(spark, sf_dir):
    records = payloads.decode(_records(spark, sf_dir))
    return latency.read_latencies(records, F.col("read_at"), F.col("arrived_at"))


STATS = """count(*) AS records, round(avg(CAST(publish_to_read_latency_ms AS DECIMAL(12,2))), 6) AS mean,
  round(quantile_cont(publish_to_read_latency_ms, 0.5), 6) AS median,
  round(stddev_pop(publish_to_read_latency_ms), 6) AS std,
  round(quantile_cont(publish_to_read_latency_ms, 0.95), 6) AS p95,
  round(quantile_cont(publish_to_read_latency_ms, 0.99), 6) AS p99, max(publish_to_read_latency_ms) AS max,
  round(avg(CAST(arrival_latency_ms AS DECIMAL(12,2))), 6) AS arrival_mean,
  round(quantile_cont(arrival_latency_ms, 0.95), 6) AS arrival_p95"""
SEGMENT = """CASE WHEN hour_no IN (12, 13, 18, 19) THEN 'peak'
  WHEN hour_no IN (8, 9, 10, 11, 14, 15, 16, 17, 20, 21) THEN 'shoulder' ELSE 'off-peak' END"""


@query(
    LATENCY
    + f""" SELECT 'all' AS segment, {STATS} FROM log
  UNION ALL SELECT {SEGMENT} AS segment, {STATS} FROM log GROUP BY 1"""
)
def latency_stats(spark, sf_dir):
    stats = latency.latency_stats(tables.read_log(spark, sf_dir))
    rounded = ("mean", "median", "std", "p95", "p99", "arrival_mean", "arrival_p95")
    return stats.withColumns({c: F.round(c, 6) for c in rounded})


@query(
    LATENCY
    + f""" SELECT round(quantile_cont(publish_to_read_latency_ms, 0.95) FILTER ({SEGMENT} = 'peak')
  / quantile_cont(publish_to_read_latency_ms, 0.95) FILTER ({SEGMENT} = 'off-peak'), 6) AS p95_peak_ratio FROM log"""
)
def latency_peak_ratio(spark, sf_dir):
    ratio = latency.peak_to_off_peak(latency.latency_stats(tables.read_log(spark, sf_dir)))
    return ratio.select(F.round("p95_peak_ratio", 6).alias("p95_peak_ratio"))


@query(
    EVENTS
    + f""" SELECT date_trunc('minute', event_ts) AS period_start,
  date_trunc('minute', event_ts) + INTERVAL 1 MINUTE AS period_end, count(*) AS records
  FROM ev GROUP BY ALL HAVING count(*) >= {ALARM_RECORDS}"""
)
def ingestion_alarm(spark, sf_dir):
    return latency.ingestion_alarms(tables.replay_events(spark, sf_dir), "event_ts", ALARM_RECORDS)


def _numbered(spark, sf_dir):
    events = tables.replay_events(spark, sf_dir).select("event_id", "store_id", "event_ts")
    return publishing.with_batch_number(events)


def _progress(spark, sf_dir):
    """Publish log of a replay in which a batch takes 100 ms plus 1 ms per record."""
    batches = publishing.batch_log(
        _numbered(spark, sf_dir), F.col("store_id") == "error", F.lit(100) + F.count("*")
    )
    return publishing.publish_progress(publishing.with_batch_sequence(batches))


BATCHES = (
    EVENTS
    + f""", numbered AS (
  SELECT event_id, store_id, CAST(hour(event_ts) AS INTEGER) AS event_hour,
    (row_number() OVER by_hour - 1) // {publishing.BATCH_SIZE} AS batch_no,
    (row_number() OVER by_hour - 1) % {publishing.BATCH_SIZE} AS batch_place, product_id
  FROM ev WINDOW by_hour AS (PARTITION BY hour(event_ts) ORDER BY event_ts, event_id))"""
)
PROGRESS = (
    BATCHES
    + f""", batches AS (
  SELECT event_hour, batch_no, count(*) AS n, count(*) FILTER (store_id = 'error') AS failed FROM numbered GROUP BY ALL
), running AS (
  SELECT *, row_number() OVER w - 1 AS batch_seq, CAST(sum(n) OVER w AS BIGINT) AS published,
    CAST(sum(100 + n) OVER w AS BIGINT) AS millis FROM batches WINDOW w AS (ORDER BY event_hour, batch_no)
), progress AS (
  SELECT 'replay' AS run_id, batch_seq, lpad(CAST(event_hour AS VARCHAR), 2, '0') || ':00' AS event_hour,
    n AS batch_records, published AS published_records, CAST(millis AS DECIMAL(18,3)) / 1000 AS elapsed,
    CAST(millis / 1000.0 AS DECIMAL(18,3)) AS elapsed_seconds,
    {two_digits('published / (millis / 1000.0)')} AS records_per_second, failed AS transient_failed_records
  FROM running
)"""
)


@query(
    BATCHES
    + """ SELECT event_id, event_hour, CAST(batch_no AS BIGINT) AS batch_no, CAST(batch_place AS BIGINT) AS batch_place
  FROM numbered"""
)
def replay_batches(spark, sf_dir):
    return _numbered(spark, sf_dir).select("event_id", "event_hour", "batch_no", "batch_place")


@query(
    EVENTS
    + f""", hours AS (
  SELECT hour(event_ts) AS h, count(*) AS n, ceil(count(*) / {publishing.BATCH_SIZE}) AS batches FROM ev GROUP BY 1
), ranked AS (
  SELECT *, {publishing.HOUR_SECONDS} / batches AS spacing, row_number() OVER (ORDER BY h) - 1 AS r FROM hours),
plan AS (SELECT *, unnest(range(CAST(batches AS BIGINT))) AS batch_no FROM ranked)
SELECT lpad(CAST(h AS VARCHAR), 2, '0') || ':00' AS event_hour, batch_no,
  least({publishing.BATCH_SIZE}, n - batch_no * {publishing.BATCH_SIZE}) AS batch_records, CAST(spacing AS DOUBLE)
  AS spacing_seconds, CAST(r * {publishing.HOUR_SECONDS} + batch_no * spacing AS DOUBLE) AS release_offset_seconds
  FROM plan"""
)
def replay_plan(spark, sf_dir):
    return publishing.replay_plan(tables.replay_events(spark, sf_dir))


@query(
    PROGRESS
    + """ SELECT run_id, batch_seq, event_hour, batch_records, published_records, elapsed_seconds, records_per_second,
  transient_failed_records FROM progress"""
)
def publish_progress(spark, sf_dir):
    return _progress(spark, sf_dir)


@query(
    PROGRESS
    + """, steps AS (SELECT event_hour,
    published_records - lag(published_records, 1, 0) OVER (ORDER BY batch_seq) AS records,
    greatest(elapsed_seconds - lag(elapsed_seconds, 1, 0) OVER (ORDER BY batch_seq), CAST(0.0001 AS DECIMAL(18,4)))
      AS seconds FROM progress)
  SELECT event_hour, CAST(sum(records) AS BIGINT) AS records, CAST(sum(seconds) AS DECIMAL(18,4)) AS seconds,
    max(records / CAST(seconds AS DOUBLE)) AS max_records_per_second FROM steps GROUP BY 1"""
)
def publish_by_hour(spark, sf_dir):
    return publishing.publish_by_hour(materialise(_progress(spark, sf_dir), "progress"))


@query(
    PROGRESS
    + """ SELECT run_id, max_by(published_records, batch_seq) AS total_records,
  max_by(elapsed_seconds, batch_seq) AS elapsed_seconds, max_by(records_per_second, batch_seq) AS records_per_second,
  CAST(sum(transient_failed_records) AS BIGINT) AS transient_failed_records, count(*) AS batches
  FROM progress GROUP BY 1"""
)
def publish_summary(spark, sf_dir):
    return publishing.publish_summary(_progress(spark, sf_dir))


LANDINGS = 4


def _landed(rows, home, time="ts"):
    """Land rows out of time order: every fourth day together and one landing after the other, each back in time."""
    path = f"{home}/landed"
    landing = F.coalesce(F.dayofmonth(time) % LANDINGS, F.lit(0))
    for i in range(LANDINGS):
        rows.where(landing == i).write.parquet(f"{path}/landing={i}")
    return path


def _landing_stream(spark, path, schema):
    """Landed files as a stream, as many in a batch as a landing has: there are more of them the larger the table."""
    files = len(spark.read.schema(schema).parquet(f"{path}/*").inputFiles())
    return streams.parquet_stream(spark, f"{path}/*", schema, files_per_batch=-(-files // LANDINGS))


def _event_stream(spark, sf_dir, home):
    """The events as a stream of landings, one in a batch."""
    source = tables.table(spark, sf_dir, "events")
    return tables.from_event_table(_landing_stream(spark, _landed(source, home), source.schema))


@query(
    EVENTS
    + """ SELECT date_trunc('hour', event_ts) AS hour_start, store_id, count(DISTINCT order_id) AS order_count FROM ev
    GROUP BY 1, 2"""
)
def stream_hourly_orders(spark, sf_dir):
    """Every hour, the last one included, though files land out of time order."""
    home = scratch_path(spark, "hourly-stream")
    counts = windows.hourly_orders(spark, f"{home}/state", fold_every=2)
    windows.run_windows(_event_stream(spark, sf_dir, home), counts, f"{home}/checkpoint").awaitTermination()
    return windows.order_counts(counts.read())


@query(
    EVENTS
    + f""" SELECT date_trunc('minute', event_ts) AS period_start,
    date_trunc('minute', event_ts) + INTERVAL 1 MINUTE AS period_end, CAST(count(*) AS BIGINT) AS records FROM ev
    GROUP BY 1 HAVING count(*) >= {ALARM_RECORDS}"""
)
def stream_ingestion_alarm(spark, sf_dir):
    home = scratch_path(spark, "alarm-stream")
    periods = windows.period_counts(spark, f"{home}/state", latency.ALARM_PERIOD, fold_every=2)
    windows.run_windows(_event_stream(spark, sf_dir, home), periods, f"{home}/checkpoint").awaitTermination()
    return periods.read().where(F.col("records") >= ALARM_RECORDS)


@query(EVENTS + " SELECT DISTINCT event_id FROM ev")
def stream_dedup(spark, sf_dir):
    """Every event arrives twice, the copy five minutes later, in landings that go back in time by any span."""
    home = scratch_path(spark, "dedup-stream")
    events = _event_stream(spark, sf_dir, home).select("event_id", "event_ts")
    again = events.withColumn("event_ts", F.col("event_ts") + F.expr("INTERVAL 5 MINUTES"))
    seen = distinct_state(spark, f"{home}/state", events.select("event_id"), fold_every=2)
    run_upserts(events.unionByName(again).select("event_id"), seen, f"{home}/checkpoint").awaitTermination()
    return seen.read()


def _answered(events):
    """Failed events were turned down with a code."""
    code = F.concat(F.lit("code-"), F.col("items")[0]["product_id"])
    return events.select("event_id", "event_ts", F.when(F.col("store_id") == "error", code).alias("error_code"))


def _put_results(spark, sf_dir):
    """Two logs that know nothing of each other: requests by batch and place, and the answers by batch and place."""

    def log(events, column):
        numbered = publishing.with_batch_number(events)
        batch = F.concat_ws("-", "event_hour", "batch_no").alias("batch_id")
        return materialise(numbered.select(batch, F.col("batch_place").alias("seq"), column), f"log-{column}")

    requests = tables.replay_events(spark, sf_dir).select("event_id", "event_ts")
    return log(requests, "event_id"), log(_answered(tables.replay_events(spark, sf_dir)), "error_code")


@query(
    BATCHES
    + """ SELECT event_hour || '-' || batch_no AS batch_id, CAST(batch_place AS BIGINT) AS seq, event_id,
  'code-' || product_id AS error_code FROM numbered WHERE store_id = 'error' AND product_id IS NOT NULL"""
)
def failed_requests(spark, sf_dir):
    return publishing.failed_requests(*_put_results(spark, sf_dir))


@query(
    BATCHES
    + """ SELECT 'code-' || product_id AS error_code, count(*) AS failed_records FROM numbered
  WHERE store_id = 'error' AND product_id IS NOT NULL GROUP BY 1"""
)
def error_counts(spark, sf_dir):
    """Codes are counted where they arise; the order of the records plays no part."""
    return publishing.error_counts(_answered(tables.replay_events(spark, sf_dir)))


@query(
    EVENTS
    + """ SELECT event_id, store_id, event_ts FROM ev
  QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY event_ts, store_id) = 1"""
)
def dedup_events(spark, sf_dir):
    """Every event arrives a second time five minutes later; the first delivery stays."""
    events = tables.replay_events(spark, sf_dir).select("event_id", "store_id", "event_ts")
    again = events.withColumn("event_ts", F.col("event_ts") + F.expr("INTERVAL 5 MINUTES"))
    return latest.earliest_delivery(events.unionByName(again), order=["event_ts", "store_id"])


@query(
    EVENTS
    + """ SELECT customer_id, event_id, store_id, event_ts FROM ev
  QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY event_ts DESC, event_id DESC, store_id DESC) = 1"""
)
def upsert_latest(spark, sf_dir):
    """State per customer after three batches: the newer half, a replay of everything, and that replay again."""
    events = tables.replay_events(spark, sf_dir).select("customer_id", "event_id", "store_id", "event_ts")
    order = ["event_ts", "event_id", "store_id"]
    state = latest_state(spark, scratch_path(spark, "customers"), events, ["customer_id"], order, fold_every=1)
    state.apply(0, events.where("event_ts >= TIMESTAMP '2024-01-16'"))
    state.apply(1, events)
    state.apply(1, events)
    return state.read()


@query(
    EVENTS
    + f""", cells AS (
  SELECT s.store_id, h.hour_no, count(ev.event_id) AS orders
  FROM (SELECT DISTINCT store_id FROM ev) s CROSS JOIN (SELECT unnest(range(24)) AS hour_no) h
    LEFT JOIN ev ON ev.store_id IS NOT DISTINCT FROM s.store_id AND hour(ev.event_ts) = h.hour_no
  GROUP BY ALL
), rated AS (
  SELECT *, orders / baseline AS ratio
  FROM (SELECT *, greatest(1.0, sum(orders) OVER (PARTITION BY store_id) / 24) AS baseline FROM cells)
) SELECT store_id, lpad(CAST(hour_no AS VARCHAR), 2, '0') || ':00' AS hour, orders,
    {two_digits('baseline')} AS baseline_orders, {two_digits('ratio')} AS pressure_ratio,
    CASE WHEN orders >= {MIN_ORDERS} AND ratio >= {DAY_THRESHOLD} THEN
      CASE WHEN ratio >= {DAY_THRESHOLD} * 1.5 THEN 'CRITICAL' ELSE 'WARNING' END END AS severity,
    (SELECT count(*) FROM ev) AS processed_events, (SELECT count(*) FROM ev) AS total_source_events,
    CAST(1 AS DOUBLE) AS progress
  FROM rated"""
)
def live_snapshot(spark, sf_dir):
    """Run the live pipeline over the event files as a stream and read its state."""
    source = tables.table(spark, sf_dir, "events")
    home = scratch_path(spark, "live")
    counters = LiveCounters(spark, f"{home}/state")
    run_live(_event_stream(spark, sf_dir, home), counters, f"{home}/checkpoint").awaitTermination()
    matrix = counters.matrix()
    hot = is_alert(F.col("orders"), F.col("ratio"), DAY_THRESHOLD, MIN_ORDERS)
    graded = matrix.withColumn("severity", F.when(hot, severity(F.col("ratio"), DAY_THRESHOLD)))
    progress = counters.progress(source.agg(F.count("*").alias("n")))
    parts = {c: progress.select(c).scalar() for c in progress.columns}
    return graded.select(*MATRIX_COLUMNS, "severity").withColumns(parts)


@query(
    LATENCY
    + """ SELECT * FROM (SELECT event_hour, row_number() OVER (ORDER BY read_at, event_id) AS records_read,
    publish_to_read_latency_ms, arrival_latency_ms, partition_key, event_id FROM log)
  WHERE partition_key <> 'error'"""
)
def evidence_csv(spark, sf_dir):
    """Latency evidence through CSV; readings of failed events are no numbers and are skipped."""
    log = latency.evidence(tables.read_log(spark, sf_dir))
    reading = F.when(F.col("partition_key") == "error", "n/a").otherwise(F.col("publish_to_read_latency_ms"))
    path = scratch_path(spark, "evidence")
    write_evidence(log.withColumn("publish_to_read_latency_ms", reading), path)
    return read_latency_csv(spark, path).drop("read_timestamp_utc")


def _latency_stream(spark, sf_dir, home):
    """Encoded records landed in files, decoded and measured as a stream."""
    records = _records(spark, sf_dir)
    decoded = payloads.decode(_landing_stream(spark, _landed(records, home, "event_ts"), records.schema))
    return latency.read_latencies(decoded, F.col("read_at"), F.col("arrived_at"))


@query(
    LATENCY
    + f""" SELECT 'all' AS segment, {STATS} FROM log
  UNION ALL SELECT {SEGMENT} AS segment, {STATS} FROM log GROUP BY 1"""
)
def stream_evidence(spark, sf_dir):
    """Stream to CSV evidence, and statistics of what is read back."""
    home = scratch_path(spark, "stream-evidence")
    run_to_evidence(_latency_stream(spark, sf_dir, home), f"{home}/evidence", f"{home}/checkpoint")
    stats = latency.latency_stats(read_latency_csv(spark, f"{home}/evidence/*"))
    rounded = ("mean", "median", "std", "p95", "p99", "arrival_mean", "arrival_p95")
    return stats.withColumns({c: F.round(c, 6) for c in rounded})


OBSERVED = "CASE WHEN published_at < TIMESTAMP '2024-01-16' THEN 1 ELSE 2 END"
BOUNDS = (10, 25, 140)


@query(
    LATENCY
    + f""" SELECT row_number() OVER (ORDER BY {OBSERVED}, read_at, event_id) AS records_read, event_id, partition_key,
    publish_to_read_latency_ms, arrival_latency_ms FROM log
  UNION ALL SELECT -unnest([{", ".join(map(str, BOUNDS))}]), NULL, NULL, NULL, NULL"""
)
def bounded_observation(spark, sf_dir):
    """An observation under rising bounds, over a landing that holds more, then a second landing, then no bound.

    Every record has the number it was read as; rows below zero tell how many were written under each bound.
    """
    home = scratch_path(spark, "bounded")
    records = _records(spark, sf_dir)
    first = F.col("event_ts") < F.lit("2024-01-16").cast("timestamp")
    stopped = []
    for landing, bounds in ((first, BOUNDS[:2]), (~first, (BOUNDS[2], None))):
        records.where(landing).write.mode("append").parquet(f"{home}/landed")
        decoded = payloads.decode(streams.parquet_stream(spark, f"{home}/landed", records.schema))
        rows = latency.read_latencies(decoded, F.col("read_at"), F.col("arrived_at"))
        for bound in bounds:
            run_to_evidence(rows, f"{home}/evidence", f"{home}/checkpoint", max_records=bound)
            if bound:
                stopped.append((-read_latency_csv(spark, f"{home}/evidence/*").count(),))
    columns = ("records_read", "event_id", "partition_key", "publish_to_read_latency_ms", "arrival_latency_ms")
    log = read_latency_csv(spark, f"{home}/evidence/*").select(*columns)
    return log.unionByName(spark.createDataFrame(stopped, "records_read long"), allowMissingColumns=True)


DAYS_A_LANDING = 8
LATE = "1 hour"
CLOSING = "2024-03-01 00:00:00"


def _in_time(events):
    """The four landings of events that come in the order of time."""
    slice_no = F.floor((F.dayofmonth("event_ts") - 1) / DAYS_A_LANDING)
    return [events.where(slice_no == i) for i in range(4)]


def _closing(events):
    """One event of a later month, after which the watermark has passed all others."""
    bare = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema}
    bare |= {"event_ts": F.lit(CLOSING).cast("timestamp").alias("event_ts"), "event_id": F.lit("closing").alias("event_id")}
    return events.sparkSession.range(1).select(*bare.values())


def _run_by_landing(landings, home, start):
    """Land one part after another; after each the stream is started anew and reads what it finds.

    `start` is given the stream and the checkpoint and returns a started query. The log has the
    progress of all runs; the list holds the rows read up to each landing.
    """
    spark, schema, read = landings[0].sparkSession, landings[0].schema, []
    with ProgressLog(spark) as log:
        for landing in landings:
            landing.write.mode("append").parquet(f"{home}/landed")
            stream = streams.parquet_stream(spark, f"{home}/landed", schema)
            log.wait(start(stream, f"{home}/checkpoint"))
            read.append(log.rows_read())
    return log, read


@query(EVENTS + " SELECT store_id, CAST(hour(event_ts) AS INTEGER) AS hour, count(*) AS events FROM ev GROUP BY 1, 2")
def live_counters_update(spark, sf_dir):
    """Store hours counted in stream state over four landings, each with a new start of the stream."""
    home = scratch_path(spark, "live-update")
    counts = RunningCounts(spark, f"{home}/totals", fold_every=2)
    _run_by_landing(_in_time(tables.replay_events(spark, sf_dir)), home, counts.run)
    return counts.read()


@query(
    EVENTS
    + f""", landed AS (SELECT (day(event_ts) - 1) // {DAYS_A_LANDING} AS landing, count(*) AS n FROM ev GROUP BY 1),
  steps AS (SELECT unnest(range(4)) AS landing)
  SELECT CAST(s.landing AS INTEGER) AS landing, CAST(sum(n) AS BIGINT) AS processed_events,
    (SELECT count(*) FROM ev) AS total_source_events,
    round(CAST(sum(n) AS DOUBLE) / (SELECT count(*) FROM ev), 4) AS progress
  FROM steps s JOIN landed l ON l.landing <= s.landing GROUP BY 1"""
)
def live_progress(spark, sf_dir):
    """How far the live counters are after each landing, as the stream itself reports it."""
    home, events = scratch_path(spark, "live-progress"), tables.replay_events(spark, sf_dir)
    counts = RunningCounts(spark, f"{home}/totals")
    _, read = _run_by_landing(_in_time(events), home, counts.run)
    steps = spark.createDataFrame(list(enumerate(read)), "landing int, processed_events long")
    total = events.agg(F.count("*").alias("n")).scalar()
    ratio = F.coalesce(F.try_divide("processed_events", "total_source_events"), F.lit(0.0))
    return steps.withColumn("total_source_events", total).withColumn("progress", F.round(ratio, 4))


LATE_ROWS = f"store_id = 'error' AND day(event_ts) <= {DAYS_A_LANDING}"


@query(
    EVENTS
    + f""" SELECT date_trunc('hour', event_ts) AS hour_start, store_id, count(*) AS events,
    (SELECT count(*) FROM ev WHERE {LATE_ROWS}) AS late_rows
  FROM ev WHERE NOT ({LATE_ROWS}) GROUP BY 1, 2"""
)
def stream_closed_hours(spark, sf_dir):
    """Hours given out once when the watermark closes them; failures of the first landing come with the last, too late."""
    home, events = scratch_path(spark, "closed-hours"), tables.replay_events(spark, sf_dir)
    events = events.select("event_id", "store_id", "event_ts")
    first, second, third, last = _in_time(events)
    late = F.col("store_id") == "error"
    landings = [first.where(~late), second, third, last.unionByName(first.where(late)), _closing(events)]
    log, _ = _run_by_landing(
        landings, home, lambda rows, checkpoint: run_to_parquet(closed_hours(rows, LATE), f"{home}/hours", checkpoint)
    )
    hours = spark.read.schema("hour_start timestamp, store_id string, events long").parquet(f"{home}/hours")
    return hours.withColumn("late_rows", F.lit(log.rows_dropped()).cast("long"))


@query(EVENTS + " SELECT event_id FROM ev")
def stream_dedup_watermark(spark, sf_dir):
    """Every event arrives twice, the copy five minutes later; ids are forgotten when the watermark passes them."""
    home, events = scratch_path(spark, "dedup-watermark"), tables.replay_events(spark, sf_dir)
    events = events.select("event_id", "event_ts")
    again = events.withColumn("event_ts", F.col("event_ts") + F.expr("INTERVAL 5 MINUTES"))
    start = lambda rows, checkpoint: run_to_parquet(without_duplicates(rows, LATE), f"{home}/once", checkpoint)
    log, _ = _run_by_landing([*_in_time(events.unionByName(again)), _closing(events)], home, start)
    if log.rows_held() > 1:
        raise RuntimeError(f"{log.rows_held()} ids are still held behind the watermark")  # the closing one may be
    return spark.read.schema("event_id string").parquet(f"{home}/once").where("event_id <> 'closing'")


@query(
    EVENTS
    + f""" SELECT event_id, store_id, event_ts FROM ev WHERE day(event_ts) > {2 * DAYS_A_LANDING}"""
)
def stream_latest(spark, sf_dir):
    """A stream that starts when two landings are there reads the two that come after, also after a restart."""
    home = scratch_path(spark, "latest")
    events = tables.replay_events(spark, sf_dir).select("event_id", "store_id", "event_ts")
    landings = _in_time(events)
    for landing in landings[:2]:
        landing.write.mode("append").parquet(f"{home}/landed")

    def run():
        rows = streams.latest_stream(spark, f"{home}/landed", events.schema, f"{home}/position")
        run_to_parquet(rows, f"{home}/read", f"{home}/checkpoint").awaitTermination()

    run()
    for landing in landings[2:]:
        landing.write.mode("append").parquet(f"{home}/landed")
        run()
    return spark.read.schema(events.schema).parquet(f"{home}/read")


@query(
    EVENTS
    + f""" SELECT date_trunc('minute', event_ts) AS period_start,
    date_trunc('minute', event_ts) + INTERVAL 1 MINUTE AS period_end, CAST(count(*) AS BIGINT) AS records FROM ev
    GROUP BY 1 HAVING count(*) >= {ALARM_RECORDS}"""
)
def stream_alarm_notices(spark, sf_dir):
    """The alarm as it is sent: each closed minute over the limit once, from a handler that a repeat does not double."""
    home, events = scratch_path(spark, "notices"), tables.replay_events(spark, sf_dir).select("event_id", "event_ts")

    def notify(rows, batch_id):
        rows.write.mode("overwrite").parquet(f"{home}/notices/batch={batch_id}")

    def start(rows, checkpoint):
        timed = rows.withWatermark("event_ts", LATE)
        return run_alarms(latency.ingestion_alarms(timed, "event_ts", ALARM_RECORDS), notify, checkpoint)

    _run_by_landing([*_in_time(events), _closing(events)], home, start)
    return spark.read.schema("period_start timestamp, period_end timestamp, records long").parquet(f"{home}/notices/*")


@query(LIVE_SECTIONS + " SELECT * FROM sections")
def live_sections(spark, sf_dir):
    """All sections of the live dashboard, whose baseline is at least one order an hour."""
    home = scratch_path(spark, "live-sections")
    counters = LiveCounters(spark, f"{home}/state")
    counters.store_hours.fold_every = counters.products.fold_every = 2
    run_live(_event_stream(spark, sf_dir, home), counters, f"{home}/checkpoint").awaitTermination()
    return counters.snapshot(DAY_THRESHOLD, MIN_ORDERS)


@query("SELECT CAST(ts AS DATE) AS dt, event_type AS store_id, count(*) AS events FROM events GROUP BY ALL")
def dated_events(spark, sf_dir):
    """Events landed in one folder per day and read back by folder."""
    path = scratch_path(spark, "dated")
    write_dated(tables.replay_events(spark, sf_dir), path, "event_ts", "parquet")
    return spark.read.parquet(path).groupBy("dt", "store_id").agg(F.count("*").alias("events"))
