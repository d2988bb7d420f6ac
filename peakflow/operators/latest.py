"""Latest state per key, and one copy per repeated delivery."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peakflow.functions.money import amount, line_total
from peakflow.operators.items import exploded, order_total


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key. Spark keeps one row per key and map task before the shuffle, so hot keys stay small."""
    in_key = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(in_key)).where("_nth = 1").drop("_nth")


def latest_per_key(df: DataFrame, keys: Sequence[str], newest: Sequence[str]) -> DataFrame:
    """The row with the greatest `newest` columns; they have to order the rows of a key fully."""
    return first_per_key(df, keys, [F.desc(c) for c in newest])


# The columns after the id, or the position, only matter if two different events share one id.
ORDER_RANK = ("event_time", "event_id", "order_total", "order_status", "store_id", "customer_id")
ITEM_RANK = ("event_time", "event_id", "item_no", "quantity", "unit_price", "store_id")


def latest_orders(events: DataFrame) -> DataFrame:
    return latest_order_states(events).drop("event_id")


def latest_order_states(events: DataFrame) -> DataFrame:
    """Latest state per order with the event it comes from, which a later merge needs to settle ties."""
    states = events.select(
        "order_id",
        "customer_id",
        "store_id",
        F.col("event_type").alias("order_status"),
        order_total().alias("order_total"),
        F.col("event_ts").alias("event_time"),
        *_if_present(events, "updated_at"),
        "event_id",
    )
    return latest_per_key(states, ["order_id"], ORDER_RANK)


def latest_order_items(events: DataFrame) -> DataFrame:
    """One line per order and product; of two lines in one event the later position survives."""
    return latest_item_states(events).drop("event_id", "item_no")


def latest_item_states(events: DataFrame) -> DataFrame:
    """Latest line per order and product with its event and position."""
    time = F.col("event_ts").alias("event_time")
    lines = exploded(events, "event_id", "order_id", "store_id", time, *_if_present(events, "updated_at"))
    newest = latest_per_key(lines, ["order_id", "product_id"], ITEM_RANK)
    return newest.select(
        "order_id",
        "store_id",
        "product_id",
        "quantity",
        amount(F.col("unit_price")).alias("unit_price"),
        line_total(F.col("quantity"), F.col("unit_price")).alias("line_total"),
        "event_time",
        *_if_present(events, "updated_at"),
        "event_id",
        "item_no",
    )


def earliest_delivery(events: DataFrame, key: str = "event_id", order: Sequence[str] = ("event_ts",)) -> DataFrame:
    """Drop repeated deliveries of an event and keep the first in `order`."""
    return first_per_key(events, [key], [F.asc(c) for c in order])


def _if_present(df: DataFrame, *names: str) -> list[str]:
    return [n for n in names if n in df.columns]
