"""The live dashboard: counters kept up by micro-batches, and snapshots of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from peakflow.functions.money import sales
from peakflow.operators.dashboard import (
    dashboard_sections,
    event_counts,
    product_totals,
    store_hour_matrix,
)
from peakflow.operators.items import order_items
from peakflow.operators.latest import latest_per_key
from peakflow.operators.pressure import MIN_ORDERS, PEAK_THRESHOLD
from peakflow.session import state_on_disk
from peakflow.streaming.state import StateTable

LIVE_BASELINE = "fixed_24_floor1"
_STORE_HOURS = "store_id string, hour int, events long"
_PRODUCTS = (
    T.StructType().add("product_id", "string").add("units_sold", "long").add("gross_sales", T.DecimalType(18, 2))
)


def _layout(columns: str) -> T.StructType:
    return T.StructType.fromDDL(columns)


def _add_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("store_id", "hour").agg(F.sum("events").alias("events"))


def _add_products(rows: DataFrame) -> DataFrame:
    return rows.groupBy("product_id").agg(
        F.sum("units_sold").alias("units_sold"), sales(F.col("gross_sales")).alias("gross_sales")
    )


class LiveCounters:
    """Counters by store and hour and by product. Their size follows stores and products, not events."""

    def __init__(self, spark: SparkSession, path: str):
        self.store_hours = StateTable(spark, f"{path}/store_hours", _layout(_STORE_HOURS), _add_counts)
        self.products = StateTable(spark, f"{path}/products", _PRODUCTS, _add_products)

    def apply(self, events: DataFrame, batch_id: int) -> None:
        self.store_hours.apply(batch_id, event_counts(events))
        self.products.apply(batch_id, product_totals(order_items(events)))

    def counts(self) -> DataFrame:
        return self.store_hours.read()

    def matrix(self) -> DataFrame:
        return store_hour_matrix(self.counts(), LIVE_BASELINE)

    def snapshot(self, threshold: float = PEAK_THRESHOLD, min_orders: int = MIN_ORDERS) -> DataFrame:
        """All sections of the dashboard. Alerts are drawn anew from the counters, so old ones may vanish."""
        return dashboard_sections(self.counts(), self.products.read(), threshold, min_orders, LIVE_BASELINE)

    def progress(self, total_source_events: DataFrame) -> DataFrame:
        """Processed events, events of the source (one row, one column), and their ratio."""
        done = self.counts().agg(F.coalesce(F.sum("events"), F.lit(0)).alias("processed_events"))
        ratio = F.coalesce(F.try_divide("processed_events", "total_source_events"), F.lit(0.0))
        return done.withColumn("total_source_events", total_source_events.scalar()).withColumn(
            "progress", F.round(ratio, 4)
        )


class RunningCounts:
    """Events by store and hour, counted in Spark's own stream state.

    A batch hands on the new total of each key that it changed. The sink keeps the newest total, so a
    batch that runs again, or rows that reach the sink twice, change nothing.
    """

    def __init__(self, spark: SparkSession, path: str, fold_every: int = 20):
        newest = lambda rows: latest_per_key(rows, ["store_id", "hour"], ["batch"])
        self.totals = StateTable(spark, path, _layout(_STORE_HOURS).add("batch", "long"), newest, fold_every)

    def run(self, events: DataFrame, checkpoint: str) -> StreamingQuery:
        """Count what the source holds now, batch by batch, and stop; call again to go on."""
        state_on_disk(events.sparkSession)
        return (
            event_counts(events)
            .writeStream.outputMode("update")
            .foreachBatch(lambda batch, i: self.totals.apply(i, batch.withColumn("batch", F.lit(i).cast("long"))))
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )

    def read(self) -> DataFrame:
        return self.totals.read().drop("batch")


def run_live(
    events: DataFrame,
    counters: LiveCounters,
    checkpoint: str,
    after_batch: Callable[[int], None] | None = None,
) -> StreamingQuery:
    """Apply what the source holds now, batch by batch, and stop; call again to go on."""

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        batch.persist(StorageLevel.DISK_ONLY)  # read twice, by store and by product; memory is for the counting
        try:
            counters.apply(batch, batch_id)
        finally:
            batch.unpersist()
        if after_batch:
            after_batch(batch_id)

    return (
        events.writeStream.foreachBatch(on_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
