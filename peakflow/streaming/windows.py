"""Counts per window that late rows correct.

A watermark forgets closed windows, so a row that comes later than it is lost. Here the counted rows
of each micro-batch are kept in a `StateTable`; a late row joins its window like any other, and the
log tells how many rows came after their window had been given out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from peakflow.streaming.state import StateTable

_LOG = T.StructType().add("newest", "timestamp").add("rows", "long").add("late_rows", "long")


def _add_up(rows: DataFrame) -> DataFrame:
    return rows.agg(F.max("newest").alias("newest"), F.sum("rows").alias("rows"), F.sum("late_rows").alias("late_rows"))


class CorrectedWindows:
    """`counted` turns events into the rows a window is counted from; `fold` merges such rows."""

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        schema: T.StructType,
        counted: Callable[[DataFrame], DataFrame],
        fold: Callable[[DataFrame], DataFrame],
        late: str,
        time: str = "event_ts",
        fold_every: int = 20,
    ):
        self.rows = StateTable(spark, f"{path}/rows", schema, fold, fold_every)
        self.log = StateTable(spark, f"{path}/log", _LOG, _add_up, fold_every)
        self.counted, self.late, self.time = counted, late, time

    def apply(self, events: DataFrame, batch_id: int) -> None:
        newest = self.log.read(before=batch_id).first().newest
        ts = F.col(self.time)
        is_late = ts < F.lit(newest) - F.expr(f"INTERVAL {self.late}") if newest else F.lit(False)
        self.rows.apply(batch_id, self.counted(events))
        seen = events.agg(F.max(ts).alias("newest"), F.count("*").alias("rows"), F.count_if(is_late).alias("late_rows"))
        self.log.apply(batch_id, seen)

    def read(self) -> DataFrame:
        """The folded rows of all windows, those still open included."""
        return self.rows.read()


def hourly_orders(spark: SparkSession, path: str, late: str = "1 hour", fold_every: int = 20) -> CorrectedWindows:
    """Orders per store and hour; `order_counts` of its rows counts each order once in an hour."""
    schema = T.StructType().add("hour_start", "timestamp").add("store_id", "string").add("order_id", "string")

    def counted(events: DataFrame) -> DataFrame:
        return events.select(F.date_trunc("hour", "event_ts").alias("hour_start"), "store_id", "order_id")

    return CorrectedWindows(spark, path, schema, counted, DataFrame.distinct, late, fold_every=fold_every)


def order_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("hour_start", "store_id").agg(F.count("order_id").alias("order_count"))


def period_counts(
    spark: SparkSession, path: str, period: str, late: str = "1 hour", fold_every: int = 20
) -> CorrectedWindows:
    """Records per tumbling period."""
    schema = T.StructType().add("period_start", "timestamp").add("period_end", "timestamp").add("records", "long")
    keys = ["period_start", "period_end"]

    def counted(events: DataFrame) -> DataFrame:
        per_period = events.groupBy(F.window("event_ts", period).alias("p")).agg(F.count("*").alias("records"))
        return per_period.select(F.col("p.start").alias(keys[0]), F.col("p.end").alias(keys[1]), "records")

    def fold(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*keys).agg(F.sum("records").alias("records"))

    return CorrectedWindows(spark, path, schema, counted, fold, late, fold_every=fold_every)


def run_windows(events: DataFrame, windows: CorrectedWindows, checkpoint: str) -> StreamingQuery:
    return (
        events.writeStream.foreachBatch(windows.apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
