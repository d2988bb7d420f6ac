"""Order events, read logs and publish logs seen through the star-schema tables.

Nothing is gathered per order here: a shipped line is one event that carries its own items,
so an order with any number of lines stays spread over the cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from peakflow.functions.times import hour_label, millis_between

ISO = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _item(product: Column, quantity: Column, price: Column) -> Column:
    return F.struct(
        product.alias("product_id"),
        quantity.cast("int").alias("quantity"),
        price.cast("double").alias("unit_price"),
    )


def replay_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as order events of one item; the event type plays the store."""
    return from_event_table(table(spark, sf_dir, "events"))


def from_event_table(rows: DataFrame) -> DataFrame:
    key = F.col("event_id").cast("string")
    product = F.concat(F.lit("k"), F.get_json_object("props", "$.k"))
    return rows.select(
        key.alias("event_id"),
        key.alias("order_id"),
        F.col("user_id").cast("string").alias("customer_id"),
        F.col("event_type").alias("store_id"),
        F.lit("PAID").alias("event_type"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("event_time"),
        F.array(_item(product, F.lit(1), F.col("value"))).alias("items"),
        F.col("ts").cast("timestamp").alias("event_ts"),
    )


def _shipped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with their order, customer and part.

    The line table is on the side that AQE may split, so a hot order or part is spread.
    """
    lines = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders")
    parts = table(spark, sf_dir, "part")
    priced = lines.join(parts, lines.l_partkey == parts.p_partkey, "left")
    headers = orders.join(
        table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left"
    )
    return priced.join(headers, F.col("l_orderkey") == F.col("o_orderkey"))


def _bare_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders without a line. Keys are made unique first, so a hot order costs one row."""
    orders = table(spark, sf_dir, "orders")
    with_lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return orders.join(with_lines, "o_orderkey", "left_anti").join(
        table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left"
    )


def _line_event_id() -> Column:
    return F.concat_ws(
        "-", "l_orderkey", F.date_format("l_shipdate", "yyyyMMdd"), "l_linenumber", "l_partkey"
    )


def _line_items(quantity: Column, price: Column) -> Column:
    part = _item(F.concat(F.lit("part-"), F.col("l_partkey")), quantity, price)
    supply = _item(F.concat(F.lit("supp-"), F.col("l_suppkey")), F.lit(1), F.col("l_extendedprice"))
    return F.array(part, supply)


_NO_ITEMS = "array<struct<product_id:string,quantity:int,unit_price:double>>"


def line_events(spark: SparkSession, sf_dir: str, with_bare_orders: bool = True) -> DataFrame:
    """Each shipped line as an event with two items, the part and its supply.

    Orders that have no line yet appear as events without items.
    """
    lines = _shipped_lines(spark, sf_dir).select(
        _line_event_id().alias("event_id"),
        F.col("o_orderkey").cast("string").alias("order_id"),
        F.col("o_custkey").cast("string").alias("customer_id"),
        F.col("c_nationkey").cast("string").alias("store_id"),
        F.col("l_linestatus").alias("event_type"),
        F.date_format("l_shipdate", ISO).alias("event_time"),
        _line_items(F.col("l_quantity"), F.col("p_retailprice")).alias("items"),
        F.col("l_shipdate").cast("timestamp").alias("event_ts"),
    )
    if not with_bare_orders:
        return lines
    bare = _bare_orders(spark, sf_dir).select(
        F.col("o_orderkey").cast("string").alias("event_id"),
        F.col("o_orderkey").cast("string").alias("order_id"),
        F.col("o_custkey").cast("string").alias("customer_id"),
        F.col("c_nationkey").cast("string").alias("store_id"),
        F.col("o_orderstatus").alias("event_type"),
        F.date_format("o_orderdate", ISO).alias("event_time"),
        F.lit(None).cast(_NO_ITEMS).alias("items"),
        F.col("o_orderdate").cast("timestamp").alias("event_ts"),
    )
    return lines.unionByName(bare)


def raw_line_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same feed before any cleaning, with faults that follow from the column values.

    Pending orders have no event type, orders of unspecified priority no readable time, returned
    lines no order id; small quantities and cheap parts turn into items out of range.
    """
    not_specified = F.col("o_orderpriority") == "4-NOT SPECIFIED"
    event_type = F.nullif(F.col("o_orderstatus"), F.lit("P"))
    lines = _shipped_lines(spark, sf_dir).select(
        _line_event_id().alias("event_id"),
        F.when(F.col("l_returnflag") != "R", F.col("o_orderkey").cast("string")).alias("order_id"),
        F.col("o_custkey").cast("string").alias("customer_id"),
        F.col("c_nationkey").cast("string").alias("store_id"),
        event_type.alias("event_type"),
        F.when(not_specified, "unspecified").otherwise(F.date_format("l_shipdate", ISO)).alias("event_time"),
        _line_items(F.col("l_quantity") - 5, (F.col("p_retailprice") - 905).cast("decimal(12,2)")).alias("items"),
    )
    bare = _bare_orders(spark, sf_dir).select(
        F.nullif(F.col("o_orderkey").cast("string"), F.lit("0")).alias("event_id"),
        F.col("o_orderkey").cast("string").alias("order_id"),
        F.col("o_custkey").cast("string").alias("customer_id"),
        F.col("c_nationkey").cast("string").alias("store_id"),
        event_type.alias("event_type"),
        F.when(not_specified, "unspecified").otherwise(F.date_format("o_orderdate", ISO)).alias("event_time"),
        F.lit(None).cast(_NO_ITEMS).alias("items"),
    )
    return lines.unionByName(bare)


def read_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publish, arrival and read time of each event; the value sets how long a record travelled."""
    ts = F.col("ts").cast("timestamp")
    travel = F.round(F.col("value") * 10000).cast("bigint")
    start = F.unix_micros(ts)
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("event_id"),
        F.col("event_type").alias("partition_key"),
        ts.alias("published_at"),
        F.timestamp_micros(start + F.floor(travel / 2)).alias("arrived_at"),
        F.timestamp_micros(start + travel).alias("read_at"),
    )


def read_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_times(spark, sf_dir).select(
        "read_at",
        hour_label(F.hour("published_at")).alias("event_hour"),
        millis_between(F.col("read_at"), F.col("published_at")).alias("publish_to_read_latency_ms"),
        millis_between(F.col("read_at"), F.col("arrived_at")).alias("arrival_latency_ms"),
        "partition_key",
        "event_id",
    )
