"""Replaying events in batches: numbering, schedule, progress and throughput."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peakflow.functions.times import hour_label
from peakflow.operators.ordering import BLOCK_ROWS, join_facts, with_previous, with_row_number, with_running_sums
from peakflow.session import materialise

# Defaults of a replay, and the shortest times rates are computed with.
BATCH_SIZE = 250
HOUR_SECONDS = 30.0
MIN_ELAPSED = "0.001"
MIN_DELTA = "0.0001"


def with_batch_number(events: DataFrame, batch_size: int = BATCH_SIZE, time: str = "event_ts") -> DataFrame:
    """`event_hour`, the batch in that hour in the order of time and id, and the place in the batch."""
    hours = events.withColumn("event_hour", F.hour(time))
    numbered = with_row_number(hours, ["event_hour"], [time, "event_id"])
    places = {"batch_no": F.floor(F.col("row_no") / batch_size), "batch_place": F.col("row_no") % batch_size}
    return numbered.withColumns(places).drop("row_no")


def replay_plan(
    events: DataFrame, batch_size: int = BATCH_SIZE, hour_seconds: float = HOUR_SECONDS, time: str = "event_ts"
) -> DataFrame:
    """When to release each batch if every event hour is replayed in `hour_seconds`.

    Batches follow from the count of each hour, so the events are counted and not sorted; long
    hours are unfolded in blocks.
    """
    hours = events.groupBy(F.hour(time).alias("hour")).agg(F.count("*").alias("records"))
    batches = F.ceil(F.col("records") / batch_size)
    by_hour = Window.orderBy("hour")  # at most 24 rows
    timed = hours.select(
        "hour",
        "records",
        batches.alias("batches"),
        ((F.row_number().over(by_hour) - 1) * F.lit(float(hour_seconds))).alias("hour_offset"),
        (F.lit(float(hour_seconds)) / batches).alias("spacing_seconds"),
    )
    blocks = timed.withColumn("block", F.explode(F.sequence(F.lit(0), F.ceil(F.col("batches") / BLOCK_ROWS) - 1)))
    first = F.col("block") * BLOCK_ROWS
    last = F.least(first + BLOCK_ROWS, F.col("batches")) - 1
    unfolded = blocks.repartition("hour", "block").withColumn("batch_no", F.explode(F.sequence(first, last)))
    return unfolded.select(
        hour_label(F.col("hour")).alias("event_hour"),
        "batch_no",
        F.least(F.lit(batch_size), F.col("records") - F.col("batch_no") * batch_size).alias("batch_records"),
        "spacing_seconds",
        (F.col("hour_offset") + F.col("batch_no") * F.col("spacing_seconds")).alias("release_offset_seconds"),
    )


def batch_log(numbered: DataFrame, failed: Column, millis: Column, run_id: str = "replay") -> DataFrame:
    """One row per batch, numbered through the run by hour and batch.

    `failed` marks records that needed a retry, `millis` is the time a batch took, as an aggregate.
    """
    per_batch = numbered.groupBy("event_hour", "batch_no").agg(
        F.count("*").alias("batch_records"),
        F.count_if(failed).alias("transient_failed_records"),
        millis.cast("bigint").alias("batch_millis"),
    )
    return per_batch.withColumn("run_id", F.lit(run_id))


def with_batch_sequence(batches: DataFrame) -> DataFrame:
    """`batch_seq`: batches are consecutive within an hour, so each hour shifts by the batches before it.

    The batches are stored first; numbering and running totals read them several times.
    """
    keys = ["run_id", "event_hour"]
    batches = materialise(batches, "batches")
    hours = batches.groupBy(*keys).agg(F.count("*").alias("_batches"))
    earlier = Window.partitionBy("run_id").orderBy("event_hour").rowsBetween(Window.unboundedPreceding, -1)
    shifts = hours.select(*keys, F.coalesce(F.sum("_batches").over(earlier), F.lit(0)).alias("_shift"))
    shifted = join_facts(batches, shifts, keys)
    return shifted.withColumn("batch_seq", F.col("_shift") + F.col("batch_no")).drop("_shift")


def publish_progress(batches: DataFrame) -> DataFrame:
    """Records published so far, time elapsed and mean rate after each batch."""
    sums = {"published_records": "batch_records", "_millis": "batch_millis"}
    elapsed = F.greatest(F.col("_millis") / F.lit(1000), F.lit(MIN_ELAPSED).cast("decimal(18,3)"))
    return with_running_sums(batches, "run_id", "batch_seq", sums).select(
        "run_id",
        "batch_seq",
        hour_label(F.col("event_hour")).alias("event_hour"),
        "batch_records",
        "published_records",
        elapsed.cast("decimal(18,3)").alias("elapsed_seconds"),
        F.round(F.col("published_records") / elapsed.cast("double"), 2).alias("records_per_second"),
        "transient_failed_records",
    )


def publish_by_hour(progress: DataFrame) -> DataFrame:
    """Records, seconds and best rate per event hour, from the steps between progress rows."""
    steps = with_previous(
        progress, "run_id", "batch_seq", {"_published": "published_records", "_elapsed": "elapsed_seconds"}
    )
    records = F.col("published_records") - F.col("_published")
    seconds = F.greatest(F.col("elapsed_seconds") - F.col("_elapsed"), F.lit(MIN_DELTA).cast("decimal(18,4)"))
    steps = steps.select("event_hour", records.alias("records"), seconds.alias("seconds"))
    return steps.groupBy("event_hour").agg(
        F.sum("records").alias("records"),
        F.sum("seconds").cast("decimal(18,4)").alias("seconds"),
        F.max(F.col("records") / F.col("seconds").cast("double")).alias("max_records_per_second"),
    )


def publish_summary(progress: DataFrame) -> DataFrame:
    """Where a run ended: totals of its last row, retried records and batches."""

    def last(column: str, name: str) -> Column:
        return F.max_by(column, "batch_seq").alias(name)

    return progress.groupBy("run_id").agg(
        last("published_records", "total_records"),
        last("elapsed_seconds", "elapsed_seconds"),
        last("records_per_second", "records_per_second"),
        F.sum("transient_failed_records").alias("transient_failed_records"),
        F.count("*").alias("batches"),
    )


def failed_requests(requests: DataFrame, results: DataFrame) -> DataFrame:
    """Records of a batch whose result at the same place carries an error code."""
    errors = results.where("error_code IS NOT NULL").select("batch_id", "seq", "error_code")
    return requests.join(errors, ["batch_id", "seq"])


def error_counts(results: DataFrame) -> DataFrame:
    return results.where("error_code IS NOT NULL").groupBy("error_code").agg(F.count("*").alias("failed_records"))
