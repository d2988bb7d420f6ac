"""From nested events to order lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakflow.functions.money import amount, line_total


def order_total(items: str = "items") -> Column:
    """Sum over the items of one event; NULL for no list or an item without number, 0 for an empty list."""
    zero = F.lit(0).cast("decimal(12,2)")
    return F.aggregate(items, zero, lambda acc, i: amount(acc + line_total(i["quantity"], i["unit_price"])))


def exploded(events: DataFrame, *columns) -> DataFrame:
    """One row per item with its position in the event, items without a product left out.

    Exploded outer, because for the inner form Spark first tests the size of each array, which
    builds the array twice where it is computed; the filter drops the empty rows anyway.
    """
    lines = events.select(*columns, F.posexplode_outer("items").alias("item_no", "item"))
    return lines.where("item.product_id IS NOT NULL").select("*", "item.*").drop("item")


def order_items(events: DataFrame) -> DataFrame:
    """Every sound line of every event, duplicates of a product included."""
    keys = [F.col(c) for c in ("event_id", "order_id", "customer_id", "store_id", "event_type")]
    lines = exploded(events, *keys, F.col("event_ts").alias("event_time"))
    return lines.where("quantity > 0 AND unit_price >= 0").withColumn(
        "line_total", line_total(F.col("quantity"), F.col("unit_price"))
    )
