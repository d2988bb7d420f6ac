"""Stream forms of the operators: late rows, duplicates, hourly counts, latency, latest state."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from peakflow.operators.latency import evidence
from peakflow.operators.latest import latest_per_key
from peakflow.session import state_on_disk
from peakflow.sinks.files import write_evidence
from peakflow.streaming.state import StateTable


def without_duplicates(events: DataFrame, late: str, key: str = "event_id", time: str = "event_ts") -> DataFrame:
    """Each id once as long as its copies arrive within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def hourly_order_counts(events: DataFrame, late: str, time: str = "event_ts") -> DataFrame:
    """Distinct orders per store and hour.

    Streams have no distinct count, so repeated (order, hour, store) rows go first; `late` of an hour
    or more keeps an order in mind for its whole hour. Rows later than the watermark are left out;
    `windows.hourly_orders` corrects closed hours too.
    """
    hours = events.withColumn("hour_start", F.date_trunc("hour", time))
    once = hours.withWatermark(time, late).dropDuplicatesWithinWatermark(["order_id", "hour_start", "store_id"])
    per_hour = once.groupBy(F.window(time, "1 hour"), "store_id").agg(F.count("*").alias("order_count"))
    return per_hour.select(F.col("window.start").alias("hour_start"), "store_id", "order_count")


def closed_hours(events: DataFrame, late: str, time: str = "event_ts") -> DataFrame:
    """Events per store and hour, given out once the watermark has passed the hour, and then forgotten.

    Copies of an event go first, within the watermark. That operator sees every row, so the rows it
    drops are the late ones, one by one; `ProgressLog.rows_dropped` tells how many they were.
    """
    once = without_duplicates(events, late, time=time)
    per_hour = once.groupBy(F.window(time, "1 hour"), "store_id").agg(F.count("*").alias("events"))
    return per_hour.select(F.col("window.start").alias("hour_start"), "store_id", "events")


def run_to_parquet(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    state_on_disk(rows.sparkSession)
    return (
        rows.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


class _BoundReached(Exception):
    """Ends an observation at its bound, with the batch it stopped in still to be done."""


def run_to_evidence(rows: DataFrame, path: str, checkpoint: str, max_records: int | None = None) -> int:
    """Read latencies to CSV evidence, one folder per batch; returns how many records are written in all.

    `max_records` bounds what is written by this run and those before it, to the record: a batch that
    goes beyond it is written up to the bound and not committed. A later run with a higher bound, or
    none, reads that batch again and replaces its folder, so no record is passed over or there twice.
    Records of a batch are numbered in the order of reading, which is the same each time.
    """
    spark, state = rows.sparkSession, T.StructType().add("records", "long")
    written = StateTable(spark, f"{path}-written", state, lambda n: n.agg(F.sum("records").alias("records")))
    at_bound: list[int] = []

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        earlier = written.read(before=batch_id).first()["records"] or 0
        room = None if max_records is None else max_records - earlier
        if room is None or room > 0:
            seen = Observation()
            log = evidence(batch, earlier).observe(seen, F.count("*").alias("records"))
            kept = log if room is None else log.where(F.col("records_read") <= max_records)
            write_evidence(kept, f"{path}/batch={batch_id}", mode="overwrite")
            records = seen.get["records"]
            kept_records = records if room is None else min(records, room)
            written.apply(batch_id, spark.createDataFrame([(kept_records,)], state))
            if kept_records == records:
                return
        at_bound.append(batch_id)
        raise _BoundReached(f"{max_records} records are read")

    query = rows.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    try:
        query.start().awaitTermination()
    except StreamingQueryException:
        if not at_bound:
            raise
    return written.read().first()["records"] or 0


def latest_state(
    spark: SparkSession, path: str, like: DataFrame, keys: list[str], newest: list[str], fold_every: int = 20
) -> StateTable:
    """Current row per key over all batches so far; an older event in a later batch changes nothing."""
    return StateTable(spark, path, like.schema, lambda rows: latest_per_key(rows, keys, newest), fold_every)


def distinct_state(spark: SparkSession, path: str, like: DataFrame, fold_every: int = 20) -> StateTable:
    """Each row once over all batches so far, however late its copies come: no watermark forgets it."""
    return StateTable(spark, path, like.schema, DataFrame.distinct, fold_every)


def run_upserts(rows: DataFrame, state: StateTable, checkpoint: str) -> StreamingQuery:
    def on_batch(batch: DataFrame, batch_id: int) -> None:
        state.apply(batch_id, batch)

    return (
        rows.writeStream.foreachBatch(on_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def run_alarms(alarms: DataFrame, notify, checkpoint: str) -> StreamingQuery:
    """Hand each closed period over the threshold to `notify(rows, batch_id)`."""
    state_on_disk(alarms.sparkSession)
    return (
        alarms.writeStream.foreachBatch(notify)
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
