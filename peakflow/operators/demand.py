"""Demand by day, store and product, and its roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakflow.functions.money import grand_total, sales


def line_measures() -> list:
    return [
        F.countDistinct("order_id").alias("order_count"),
        F.sum("quantity").cast("bigint").alias("units_sold"),
        sales(F.col("line_total")).alias("gross_sales"),
    ]


def product_demand_daily(items: DataFrame) -> DataFrame:
    """Distinct orders, units and sales.

    Lines are dealt once, by day and product. So lie the orders of each, which are counted there, and the
    roll-up over stores needs no shuffle either; a product in much demand is spread over its days.
    """
    needed = ("store_id", "product_id", "order_id", "quantity", "line_total")
    dealt = items.select(F.to_date("event_time").alias("demand_date"), *needed).repartition("demand_date", "product_id")
    return dealt.groupBy("demand_date", "store_id", "product_id").agg(*line_measures())


def roll_up(demand: DataFrame, *keys: str) -> DataFrame:
    """Sum demand over the other keys. An order counts once per product and store it appears in."""
    return demand.groupBy(*keys).agg(
        F.sum("order_count").alias("order_count"),
        F.sum("units_sold").alias("units_sold"),
        sales(F.col("gross_sales")).alias("gross_sales"),
    )


def product_leaderboard(demand: DataFrame) -> DataFrame:
    board = roll_up(demand, "demand_date", "product_id")
    return board.orderBy(F.desc("demand_date"), F.desc("gross_sales"), "product_id")


def store_daily_summary(demand: DataFrame) -> DataFrame:
    return roll_up(demand, "demand_date", "store_id").orderBy(F.desc("demand_date"), "store_id")


def store_daily_summary_from_items(items: DataFrame) -> DataFrame:
    """The same summary plus `distinct_orders`, which counts an order once however many products it has.

    Lines are first reduced to one row per order and product, which both counts are read from.
    """
    per_order = items.groupBy(
        F.to_date("event_time").alias("demand_date"), "store_id", "order_id", "product_id"
    ).agg(F.sum("quantity").alias("units"), F.sum("line_total").alias("amount"))
    summary = per_order.groupBy("demand_date", "store_id").agg(
        F.count("order_id").alias("order_count"),
        F.countDistinct("order_id").alias("distinct_orders"),
        F.sum("units").alias("units_sold"),
        sales(F.col("amount")).alias("gross_sales"),
    )
    return summary.orderBy(F.desc("demand_date"), "store_id")


def order_status_summary(orders: DataFrame) -> DataFrame:
    measures = [F.count("*").alias("order_count"), grand_total(F.col("order_total")).alias("gross_sales")]
    if "updated_at" in orders.columns:
        measures.append(F.max("updated_at").alias("latest_update_at"))
    return orders.groupBy("order_status").agg(*measures).orderBy(F.desc("order_count"), "order_status")
