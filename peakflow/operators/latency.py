"""Publish-to-read latency, its statistics, and the ingestion alarm."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakflow.functions.bands import latency_segment
from peakflow.functions.times import hour_from_label, hour_label_from_text, millis_between
from peakflow.operators.ordering import percentiles, sorted_slices, with_row_number

# Reported segments and percents, and the alarm rule.
SEGMENTS = ("all", "peak", "shoulder", "off-peak")
PERCENTS = {"median": 50, "p95": 95, "p99": 99}
ALARM_RECORDS = 40_000
ALARM_PERIOD = "60 seconds"


def read_latencies(records: DataFrame, read_at: Column, arrived_at: Column) -> DataFrame:
    """Latency of each decoded record; NULL where no publish time travelled with it."""
    published_at = F.try_to_timestamp("_published_at_utc")
    return records.select(
        read_at.alias("read_at"),
        hour_label_from_text(F.coalesce("event_time", F.lit(""))).alias("event_hour"),
        millis_between(read_at, published_at).alias("publish_to_read_latency_ms"),
        millis_between(read_at, arrived_at).alias("arrival_latency_ms"),
        "partition_key",
        "event_id",
    )


def with_records_read(log: DataFrame) -> DataFrame:
    """How many records had been read when each one was, itself included."""
    numbered = with_row_number(log, [], ["read_at", "event_id"], "_earlier")
    return numbered.withColumn("records_read", F.col("_earlier") + 1).drop("_earlier")


def evidence(log: DataFrame, earlier: int = 0) -> DataFrame:
    """The log in the layout of the evidence files; `earlier` records had been read before it."""
    numbered = with_records_read(log)
    return numbered.select(
        F.date_format("read_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("read_timestamp_utc"),
        "event_hour",
        (F.col("records_read") + F.lit(earlier)).alias("records_read"),
        F.col("publish_to_read_latency_ms").cast("string").alias("publish_to_read_latency_ms"),
        F.col("arrival_latency_ms").cast("string").alias("arrival_latency_ms"),
        "partition_key",
        "event_id",
    )


def _value_counts(log: DataFrame) -> DataFrame:
    """How often each latency occurs, per segment and over all. A blank hour counts in `all` only."""
    measures = F.array(
        F.struct(F.lit("publish").alias("measure"), F.col("publish_to_read_latency_ms").alias("ms")),
        F.struct(F.lit("arrival").alias("measure"), F.col("arrival_latency_ms").alias("ms")),
    )
    complete = log.dropna(subset=["publish_to_read_latency_ms", "arrival_latency_ms"])
    values = complete.select(
        latency_segment(hour_from_label(F.col("event_hour"))).alias("segment"), F.explode(measures).alias("m")
    )
    counted = values.groupBy("segment", "m.measure", "m.ms").agg(F.count("*").alias("n"))
    labels = F.array_compact(F.array(F.lit("all"), F.col("segment")))
    widened = counted.select(F.explode(labels).alias("segment"), "measure", "ms", "n")
    return widened.groupBy("segment", "measure", "ms").agg(F.sum("n").alias("n"))


def _moments(counts: DataFrame) -> DataFrame:
    """Count, mean, population deviation and maximum, with sums in decimal.

    A figure that does not fit is NULL: a mean beyond 300 years, say.
    """
    ms = F.col("ms").try_cast("decimal(15,2)")
    n, total = F.sum("n"), F.try_sum(F.try_multiply("n", ms))
    squares = F.try_sum(F.try_multiply("n", F.try_multiply(ms, ms)))
    spread = F.try_subtract(F.try_multiply(squares, n), F.try_multiply(total, total))
    return counts.groupBy("segment", "measure").agg(
        n.alias("records"),
        (total.cast("double") / n).alias("mean"),
        (F.sqrt(spread.cast("double")) / n).alias("std"),
        F.max("ms").alias("max"),
    )


def latency_stats(log: DataFrame) -> DataFrame:
    """Statistics of both latencies per segment; segments without records give zeros."""
    group = ["segment", "measure"]
    counts = sorted_slices(_value_counts(log), [*group, "ms"], "latencies")
    stats = _moments(counts).join(percentiles(counts, group, "ms", "n", PERCENTS), group)

    def of(measure: str, column: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("measure") == measure, F.col(column))), F.lit(0)).alias(
            column if measure == "publish" else f"{measure}_{column}"
        )

    spine = log.sparkSession.range(1).select(F.explode(F.lit(list(SEGMENTS))).alias("segment"))
    publish = ["records", "mean", "median", "std", "p95", "p99", "max"]
    return (
        spine.join(stats, "segment", "left")
        .groupBy("segment")
        .agg(*[of("publish", c) for c in publish], of("arrival", "mean"), of("arrival", "p95"))
    )


def ingestion_alarms(
    records: DataFrame, time: str, threshold: int = ALARM_RECORDS, period: str = ALARM_PERIOD, late: str | None = None
) -> DataFrame:
    """Periods that took in at least `threshold` records. A period without records raises nothing.

    Works on a table and, with a watermark `late`, on a stream.
    """
    timed = records.withWatermark(time, late) if late else records
    per_period = timed.groupBy(F.window(time, period).alias("period")).agg(F.count("*").alias("records"))
    return per_period.where(F.col("records") >= threshold).select(
        F.col("period.start").alias("period_start"), F.col("period.end").alias("period_end"), "records"
    )


def peak_to_off_peak(stats: DataFrame) -> DataFrame:
    """How much slower peak hours are than off-peak hours; NULL without off-peak records."""

    def p95(segment: str) -> Column:
        return F.max(F.when(F.col("segment") == segment, F.col("p95")))

    return stats.agg(F.try_divide(p95("peak"), F.nullif(p95("off-peak"), F.lit(0.0))).alias("p95_peak_ratio"))
